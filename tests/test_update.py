"""The update job over several runs, the stored tables it may work on, and the survivorship rules of a merge."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexhoard.operators import classify, history
from lexhoard.operators.merge import merge_records
from lexhoard.plans import jobs
from lexhoard.plans.store import HashedTable
from lexhoard.streaming.feeds import foreach_batch_upsert

RULES = [classify.Rule("topics", "d", [r"\bdrug\b"])]
AUTHORS = "array<struct<name:string,orcid:string,affiliations:array<string>>>"
SCHEMA = f"id string, doi string, pmid string, title string, abstract string, source_types array<string>, source_ids map<string,string>, keywords array<string>, authors {AUTHORS}, excluded boolean, updated_date date, retrieved_at timestamp"


def _row(i, doi=None, source="rss", title="t drug", abstract=None, keywords=(), pmid=None, day=1, at=1):
    return (i, doi, pmid, title, abstract, [source], {source: i}, list(keywords), [], False, dt.date(2024, 2, day), dt.datetime(2024, 2, at))


@pytest.fixture(scope="module")
def job(spark):
    roster = spark.createDataFrame([], "person string, position long, orcid string, aliases array<string>, affiliation_terms array<string>, require_affiliation boolean, active boolean")
    works = spark.createDataFrame([], "doi string, publisher string")
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)

    def run(corpus, *rows, days=60):
        return jobs.update(corpus, table(rows), roster, works, RULES, "2024-02-28", days, F.col("updated_date"))

    run.table, run.roster, run.works = table, roster, works
    return run


def _seen(update):
    return {tuple(sorted(r["keywords"])): (r["id"], r["title"], r["abstract"]) for r in update.records.collect()}


def test_other_members_keep_their_values(job):
    a, b = _row("a", "10.1/x", "pubmed", "best", "old", ["ka"], pmid="5"), _row("b", "https://doi.org/10.1/X", "crossref", "other", "theirs", ["kb"])
    c = _row("c", None, "rss", "alone", "text", ["kc"])
    first = job(None, a, b, c)
    assert _seen(first) == {("ka", "kb"): ("doi:10.1/x", "best", "old"), ("kc",): ("c", "alone", "text")}
    # One member changes and comes alone; the other's keyword stays.
    changed = _row("a", "10.1/x", "pubmed", "best", "new", ["ka2"], pmid="5", at=2)
    second = job(first.corpus, changed)
    assert _seen(second) == {("ka2", "kb"): ("doi:10.1/x", "best", "new"), ("kc",): ("c", "alone", "text")}
    assert second.report.first()["changed"] == 1
    # Nothing new: nothing changes.
    third = job(second.corpus, changed, b, c)
    assert _seen(third) == _seen(second) and third.report.first()["changed"] == 0
    # A row of a third source links by PMID and joins; the other source links elsewhere and leaves.
    fourth = job(third.corpus, _row("d", None, "biorxiv", "more", None, ["kd"], pmid="5"), _row("b", "10.1/c", "crossref", "other", "theirs", ["kb"], at=3))
    assert _seen(fourth) == {("ka2", "kd"): ("doi:10.1/x", "best", "new"), ("kb",): ("b", "other", "theirs"), ("kc",): ("c", "alone", "text")}
    # The row that stood alone takes the DOI of the one that left.
    fifth = job(fourth.corpus, _row("c", "10.1/C", "rss", "alone", "text", ["kc"], at=4))
    assert _seen(fifth) == {("ka2", "kd"): ("doi:10.1/x", "best", "new"), ("kb", "kc"): ("doi:10.1/c", "other", "theirs")}
    assert [(r["kept_id"], r["merged_id"], r["reason"]) for r in fifth.decisions.collect()] == [("b @crossref", "c @rss", "same DOI")]


def test_pruned_records_take_their_members_along(job):
    first = job(None, _row("a", "10.1/x", keywords=["ka"], day=3), _row("b", "10.1/x", keywords=["kb"], day=5), _row("c", keywords=["kc"], day=20))
    second = job(first.corpus, days=15)
    assert _seen(second).keys() == {("kc",)} and second.report.first()["removed"] == 1 and second.corpus.members.count() == 1
    # What was pruned counts as changed when it comes again, with whatever comes with it.
    third = job(second.corpus, _row("a", "10.1/x", keywords=["ka"], day=27))
    assert _seen(third).keys() == {("kc",), ("ka",)} and third.report.first()["changed"] == 1


def test_newest_row_of_an_id_counts(job):
    out = job(None, _row("a", title="old", at=1), _row("a", title="new", at=3), _row("a", title="older", at=2))
    assert [r["title"] for r in out.records.collect()] == ["new"]


def test_batches_write_touched_folders_only_and_run_again_without_change(spark, job, tmp_path):
    members, records = HashedTable(str(tmp_path / "members"), "id", 8), HashedTable(str(tmp_path / "records"), "cluster", 8)
    batch = jobs.foreach_batch_update(members, records, job.roster, job.works, RULES)
    rows = [_row(f"i{n}", f"10.1/{n // 2}", keywords=[f"k{n}"]) for n in range(40)]
    batch(job.table(rows), 0)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    state = lambda: ({r["id"]: (r["cluster"], tuple(r["keywords"])) for r in members.read(spark).collect()}, {r["cluster"]: (r["id"], tuple(r["keywords"])) for r in records.read(spark).collect()})
    before, was = files(), state()
    assert len(was[0]) == 40 and len(was[1]) == 20
    batch(job.table(rows), 0)
    assert files() == before
    one = job.table([_row("i6", "10.1/3", keywords=["new"], at=2)])
    batch(one, 1)
    now = state()
    assert now[1]["i6 @rss"] == ("doi:10.1/3", ("new", "k7")) and {k: v for k, v in now[1].items() if k != "i6 @rss"} == {k: v for k, v in was[1].items() if k != "i6 @rss"}
    kept = [p for p in before if p in files()]
    assert len(kept) >= 11 and len(kept) < 16  # of 16 folders, those of i6 and i7 and of their record are new
    # A batch that failed after its records were written makes the same ones and writes the members.
    (tmp_path / "members" / "ledger" / "1").unlink()
    batch(one, 1)
    assert state() == now
    # A cluster that is no more goes.
    batch(job.table([_row("i6", "10.1/4", keywords=["new"], at=3), _row("i7", "10.1/4", at=3)]), 2)
    assert set(state()[1]) == set(was[1]) - {"i8 @rss"} and len(state()[1]["i6 @rss"][1]) == 3


def test_upsert_is_idempotent_and_older_rows_do_not_return(spark, tmp_path):
    table = HashedTable(str(tmp_path / "t"), "id", 4)
    upsert = foreach_batch_upsert(table)
    make = lambda *rows: spark.createDataFrame(rows, "id string, v int, retrieved_at string")
    now = lambda: sorted((r["id"], r["v"]) for r in table.read(spark).collect())
    assert table.read(spark) is None
    upsert(make(("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("b", 1, "2024-01-01")), 0)
    assert now() == [("a", 2), ("b", 1)]
    files = {str(p): p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")}
    upsert(make(("a", 2, "2024-01-02")), 1)
    upsert(make(("a", 7, "2024-01-01")), 2)
    assert files == {str(p): p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")} and table.done(spark, 2)
    upsert(make(("b", 5, "2024-01-03"), ("c", 1, "2024-01-03")), 3)
    upsert(make(("b", 9, "2024-01-04")), 3)
    assert now() == [("a", 2), ("b", 5), ("c", 1)]
    table.apply(make(), 4, removed=make(("a", 0, ""), ("x", 0, "")))
    table.apply(make(("c", 2, "2024-01-09")), 5, removed=make(("b", 0, ""), ("c", 0, "")))
    assert now() == [("c", 2)]


PROVENANCE = "array<struct<source:string,source_id:string,retrieved_at:timestamp,fields:array<string>,note:string>>"


def test_merge_rules_of_every_field(spark):
    schema = f"""cluster string, id string, record_type string, source_types array<string>, source_ids map<string,string>, title string, abstract string, description string, authors {AUTHORS},
    organizations array<struct<name:string,kind:string>>, journal_or_source string, publisher string, relations map<string,array<string>>, doi string, pmid string, url string, alternate_urls array<string>,
    first_date date, published_date date, updated_date date, keywords array<string>, field_sources map<string,string>, provenance {PROVENANCE}, version int, excluded boolean, preprint struct<server:string,published_doi:string>"""
    day, at = (lambda d: dt.date(2024, 1, d)), dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    p = lambda source, sid: [(source, sid, at, ["title"], None)]
    journal = ("c", "doi:10.1/j", "publication", ["crossref"], {"crossref": "10.1/j", "x": "c"}, "Journal title", "crossref abstract", None, [], [("Org", "a")], None, "Press", {"cites": ["1"]}, "10.1/j", None, "https://j", ["https://k"], day(5), day(6), day(7), ["k1", ""], {"title": "crossref"}, p("crossref", "j"), 1, True, None)
    preprint = ("c", "doi:10.1/p", "preprint", ["biorxiv"], {"biorxiv": "10.1/p", "x": "b"}, "Preprint title", "preprint abstract", "about", [("Ada", None, [])], [("Org", "a"), ("Lab", "b")], "server", None, {"cites": ["2", "1"], "old": []}, "10.1/p", None, "https://p", [], day(2), None, day(3), ["k2", "k1"], {"title": "biorxiv", "doi": "biorxiv"}, p("biorxiv", "p"), 3, None, ("biorxiv", "doi:10.1/J"))
    indexed = ("c", "pmid:9", "publication", ["pubmed"], {"pubmed": "9"}, "Indexed title", "indexed abstract", None, [], None, "J", None, None, None, "9", "https://m", ["https://j"], None, day(9), None, None, None, [], None, False, None)
    alone = ("d", "z", "news", ["rss"], {}, "News", None, None, [], [], None, None, {}, None, None, "https://n", [], None, None, None, [], {}, [], 1, False, None)
    reasons = spark.createDataFrame([("c", "same DOI"), ("c", "named"), ("c", "same DOI")], "cluster string, reason string")
    results = []
    for rows in ([journal, preprint, indexed, alone], [alone, indexed, preprint, journal]):
        out = {r["cluster"]: r for r in merge_records(spark.createDataFrame(rows, schema).repartition(3), reasons).collect()}
        results.append({k: str(v) for k, v in out.items()})
    assert results[0] == results[1]
    r = out["c"].asDict()
    provenance = [(x["source"], x["source_id"], x["note"]) for x in r.pop("provenance")]
    # The best member, from pubmed, has no provenance to repeat.
    assert provenance == [("crossref", "j", None), ("biorxiv", "p", None)]
    assert out["c"]["provenance"][0]["retrieved_at"] == at
    assert {k: [tuple(x) if hasattr(x, "asDict") else x for x in v] if isinstance(v, list) else v for k, v in r.items()} == {
        "cluster": "c", "id": "doi:10.1/j", "n_members": 3, "record_type": "publication", "source_types": ["crossref", "biorxiv", "pubmed"], "source_ids": {"crossref": "10.1/j", "x": "b", "biorxiv": "10.1/p", "pubmed": "9"},
        "title": "Indexed title", "abstract": "indexed abstract", "description": "about", "authors": [("Ada", None, [])], "organizations": [("Org", "a"), ("Lab", "b")], "journal_or_source": "J", "publisher": "Press",
        "relations": {"cites": ["1", "2"], "has-preprint": ["10.1/p"]}, "doi": "10.1/j", "pmid": "9", "url": "https://m", "alternate_urls": ["https://j", "https://k", "https://p"], "first_date": day(2), "published_date": day(9), "updated_date": day(7),
        "keywords": ["k1", "k2"], "field_sources": {"title": "biorxiv", "doi": "biorxiv"}, "version": 3, "excluded": False, "preprint": None,
    }
    assert out["d"]["id"] == "z" and out["d"]["n_members"] == 1
    two = merge_records(spark.createDataFrame([journal, preprint], schema), reasons).first()
    assert [(x["source"], x["note"]) for x in two["provenance"]] == [("crossref", None), ("biorxiv", None), ("biorxiv", "merged: named, same DOI")]
    assert two["id"] == "doi:10.1/j" and two["title"] == "Preprint title" and two["abstract"] == "preprint abstract" and two["preprint"]["server"] == "biorxiv"


def test_trial_events_are_kept(spark):
    trial = "trial struct<overall_status:string,enrollment:int,phase:array<string>,sponsor:string>"
    schema = f"id string, {trial}, version int, retrieved_at timestamp, provenance array<struct<source:string,source_id:string>>"
    row = lambda i, status, n, sponsor, at: (i, (status, n, ["Phase 1"], sponsor), 1, dt.datetime(2024, 1, at), [("s", f"{i}{at}")])
    first = history.with_events(None, spark.createDataFrame([row("t", "open", 5, "A", 1), row("u", "open", 5, "A", 1)], schema))
    second = history.with_events(first, spark.createDataFrame([row("t", "closed", 7, "A", 2), row("u", "open", 5, "B", 2), row("w", "open", 1, "A", 2)], schema))
    third = history.with_events(second, spark.createDataFrame([row("t", "closed", None, "A", 3)], schema))
    out = {r["id"]: r for r in second.collect()}
    assert {i: (r["version"], len(r["change_history"])) for i, r in out.items()} == {"t": (2, 1), "u": (1, 0), "w": (1, 0)}
    assert [tuple(x) for x in out["u"]["provenance"]] == [("s", "u1"), ("s", "u2")]
    t = third.first()
    assert t["version"] == 3 and [tuple(e) for e in t["change_history"]] == [
        (dt.datetime(2024, 1, 2), "clinicaltrials", ["trial.overall_status", "trial.enrollment"], {"trial.overall_status": '{"value":"open"}', "trial.enrollment": '{"value":5}'}, {"trial.overall_status": '{"value":"closed"}', "trial.enrollment": '{"value":7}'}),
        (dt.datetime(2024, 1, 3), "clinicaltrials", ["trial.enrollment"], {"trial.enrollment": '{"value":7}'}, {"trial.enrollment": "{}"}),
    ]


def test_whole_rows_move_once(spark, job):
    first = job(None, _row("a", "10.1/x", keywords=["ka"]), _row("b", "10.1/x", keywords=["kb"]))
    second = job(first.corpus, _row("a", "10.1/x", keywords=["ka"]))
    assert _seen(second) == _seen(first) and second.corpus.members.inputFiles() == first.corpus.members.inputFiles()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = lambda df: [line for line in df._jdf.queryExecution().toString().rpartition("== Physical Plan ==")[2].splitlines() if "Exchange" in line]
        merged = merge_records(first.corpus.members.drop("version_hash"), first.decisions.select(F.col("kept_id").alias("cluster"), "reason"), "record_id")
        assert moved(merged) and not any("coalesce(" in line for line in moved(merged))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
