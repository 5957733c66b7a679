"""Cases stated by hand for single operators, and invariance of whole jobs."""

import datetime as dt
import difflib
import html
import random
import time

import pytest
from pyspark.sql import functions as F

from lexhoard.functions import dates, ids, text
from lexhoard.graph import _star, connected_components, joined_components
from lexhoard.operators import classify, dedup, people, report, select
from lexhoard.plans import jobs
from lexhoard.session import saved
from lexhoard.sources import normalize


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.normalize_doi(F.col("a")), a="HTTPS://DX.DOI.ORG/10.1000/ABC.1 . ") == "10.1000/abc.1"
    assert one(spark, text.normalize_doi(F.col("a")), a="  ") is None
    assert one(spark, text.normalize_title(F.col("a")), a="Ｌarge Straße: version 2, v3!") == "large strasse"
    assert one(spark, text.html_to_text(F.col("a"), 10), a="<p>A<script>x</script> bcd &amp; efghijk</p>") == "A bcd & ef"[:9].rstrip() + "…"
    assert one(spark, text.ascii_fold(F.col("a")), a="Élan-Vital  Ñ") == "elan vital n"
    assert one(spark, text.safe_url(F.col("a")), a="javascript:alert(1)") is None
    assert one(spark, text.sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == 0.75
    assert one(spark, text.token_jaccard(F.col("a"), F.col("b")), a="a b c", b="") == 0.0


def test_dates(spark):
    def parsed(s):
        r = one(spark, dates.parse_flexible_date(F.col("a")), a=s)
        return r and (r["value"].isoformat(), r["precision"])

    assert [parsed(x) for x in ("2024", "2024-Feb", "2024/02/29", "2024-02-30", "2026 27", "2026-13", "around 1999 or so", "none")] == [
        ("2024-01-01", "year"), ("2024-02-01", "month"), ("2024-02-29", "day"), None, None, None, ("1999-01-01", "year"), None,
    ]


def test_fingerprint_ignores_map_order_and_excluded_fields(spark):
    df = spark.sql("SELECT 1 AS id, map('a', 1, 'b', 2) AS m, 5 AS relevance_score UNION ALL SELECT 1, map('b', 2, 'a', 1), 9 UNION ALL SELECT 1, map('b', 3, 'a', 1), 9")
    prints = [r["f"] for r in df.select(ids.content_fingerprint(df).alias("f")).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_fingerprint_sees_through_structs_and_arrays(spark):
    """Maps in arrays of structs, in structs, in maps; the order of fields of structs."""
    one = "SELECT '1' AS id, array(named_struct('m', map('a', 1, 'b', 2), 't', 'x')) AS l, named_struct('p', map(1, map('k', array(map('u', 'v', 'w', 'z'))))) AS s"
    two = "SELECT '1' AS id, named_struct('p', map(1, map('k', array(map('w', 'z', 'u', 'v'))))) AS s, array(named_struct('t', 'x', 'm', map('b', 2, 'a', 1))) AS l"
    other = "SELECT '1' AS id, array(named_struct('m', map('a', 1, 'b', 3), 't', 'x')) AS l, named_struct('p', map(1, map('k', array(map('u', 'v', 'w', 'z'))))) AS s"
    of = lambda q: (df := spark.sql(q)).select(ids.content_fingerprint(df).alias("f")).first()["f"]
    assert of(one) == of(two) != of(other)
    assert of("SELECT 1 AS a, CAST(NULL AS STRUCT<x: MAP<STRING, INT>>) AS s") != of("SELECT 1 AS a, CAST(named_struct('x', NULL) AS STRUCT<x: MAP<STRING, INT>>) AS s")


def test_entities_and_folding(spark):
    rows = [("1", "<p>caf&eacute; &#8212; &#x41; &amp;lt; &hellip</p>"), ("2", "plain &amp; simple"), ("3", None), ("4", "&notanentity; x &#0; AT&T")]
    out = {r["id"]: r["t"] for r in text.html_to_text_whole(spark.createDataFrame(rows, "id string, t string"), "t", None).collect()}
    assert out == {"1": "café — A &lt; &hellip", "2": "plain & simple", "3": None, "4": "¬anentity; x \ufffd AT&T"}
    parts = lambda n: one(spark, text.author_parts(F.struct(F.col("a").alias("name"), F.lit(None).cast("string").alias("given_name"), F.lit(None).cast("string").alias("family_name"), F.lit(None).cast("string").alias("orcid"))), a=n)
    assert parts("ＡDA STRAẞE")["family"] == parts("Ada strasse")["family"] == parts("ada Straße")["family"] and parts("ＡDA X")["given"] == "ada"


def test_rules(spark):
    df = spark.createDataFrame([("1", "A drug therapy Drug", "drug"), ("2", "none", "a DRUG for crops"), ("3", None, None)], "id string, title string, abstract string")
    rules = [classify.Rule("topics", "d", [r"\bdrug\b"], [r"\bcrops\b"], minimum_score=2.0)]
    out = {r["id"]: r for r in classify.classify(df, rules).collect()}
    assert out["1"]["topics"] == ["d"] and out["2"]["topics"] == [] and out["3"]["topics"] == []
    e = out["1"]["classification_evidence"]["topics"][0]
    assert (e["matched_phrases"], e["fields"], e["confidence"]) == (["drug"], ["title", "abstract"], 1.0)
    again = classify.classify(classify.classify(df, rules), rules)
    assert [r["classification_evidence"] for r in again.orderBy("id").collect()] == [out[i]["classification_evidence"] for i in "123"]


def test_score(spark):
    row = ("1", "drug trial", ["mRNA", "ASO"], ["Phase 3"], ["human"], ["pubmed", "rss", "crossref"], dt.date(2024, 1, 5), True)
    df = spark.createDataFrame([row, ("2", *row[1:-1], False)], "id string, title string, modalities array<string>, development_stages array<string>, species array<string>, source_types array<string>, d date, excluded boolean")
    out = {r["id"]: r for r in classify.score(df, "2024-01-08", F.col("d")).collect()}
    assert out["2"]["relevance_score"] == 25 + 10 + 14 + 10 + 5 + 2 and out["1"]["relevance_score"] == 15
    for r in out.values():
        assert sum(c["points"] for c in r["score_components"]) == r["relevance_score"]


def _authors(given):
    return [(f"{given} Doe", given, "Doe", None)]


_AUTHORS = "array<struct<name:string,given_name:string,family_name:string,orcid:string>>"


def test_merge_cluster_and_title_edges_list_no_members(spark):
    def stated(plan):
        return plan._jdf.queryExecution().executedPlan().toString()

    schema = "cluster string, id string, title string, source_types array<string>, tags array<string>, excluded boolean"
    rows = [("c", "a", "first", ["rss"], ["x", "y"], True), ("c", "b", "", ["pubmed"], ["z", None, "x", ""], None), ("c", "d", "kept", ["pubmed"], None, True), ("e", "e", None, None, [], True)]
    merged = dedup.merge_cluster(spark.createDataFrame(rows, schema), ["title"], ["tags"])
    got = {r["cluster"]: tuple(r) for r in merged.collect()}
    assert got == {"c": ("c", "d", 3, "kept", ["z", "x", "y"], ["pubmed", "rss"], False), "e": ("e", "e", 1, None, [], [], True)}
    assert "collect_list(struct(rank" not in stated(merged)
    copies = [(f"{i:03}", "a title of seven plain common words", [("Anna Meyer", "Anna", "Meyer", None)], 2020) for i in range(300)]
    edges = dedup.title_edges(spark.createDataFrame(copies, f"id string, title string, authors {_AUTHORS}, year int")).collect()
    assert sorted((r["left_id"], r["right_id"], r["confidence"]) for r in edges) == [("000", f"{i:03}", 0.98) for i in range(1, 300)]


def test_title_edges(spark):
    title = "Long range delivery of small particles into the living cell nucleus"
    rows = [("1", title, _authors("Ada"), 2024), ("2", title.replace("Long range", "Long-range"), _authors("Ada"), 2024), ("3", title, _authors("Bob"), 2024), ("4", title, _authors("A"), 2029), ("5", "Short title", _authors("Ada"), 2024), ("6", "Short title", _authors("Ada"), 2024), ("7", title[:-8] + " center", _authors("A."), None)]
    edges = dedup.title_edges(spark.createDataFrame(rows, f"id string, title string, authors {_AUTHORS}, year int")).collect()
    assert {(e["left_id"], e["right_id"]): e["confidence"] for e in edges if "7" not in (e["left_id"], e["right_id"])} == {("1", "2"): 0.98}


def test_deduplicate_prefers_quality_and_keeps_order_out(spark):
    rows = [("a", "10.1/x", ["rss"], "news title", None, dt.date(2024, 1, 2), True), ("b", "10.1/X ", ["pubmed"], "", "abstract", dt.date(2024, 1, 3), False), ("c", None, ["rss"], "alone", None, None, True)]
    schema = "id string, doi string, source_types array<string>, title string, abstract string, first_date date, excluded boolean"
    results = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).repartition(3)
        merged, decisions = dedup.deduplicate(df, dedup.exact_edges(df, {"DOI": text.normalize_doi(F.col("doi"))}), ["title", "abstract"], [], first=["first_date"])
        results.append((sorted(map(str, merged.collect())), sorted(map(str, decisions.collect()))))
        r = {x["cluster"]: x for x in merged.collect()}
        assert (r["a"]["id"], r["a"]["title"], r["a"]["abstract"], r["a"]["source_types"], r["a"]["excluded"], r["a"]["first_date"]) == ("b", "news title", "abstract", ["pubmed", "rss"], False, dt.date(2024, 1, 2))
        assert r["c"]["n_members"] == 1 and r["c"]["excluded"]
    assert results[0] == results[1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    out = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}


def test_rounds_of_components_leave_the_driver_little_to_plan(spark):
    """A round reads its table four times, and edges that are stars already take one round."""
    edges = spark.range(40).selectExpr("id + 100 AS u", "id % 4 AS v")
    assert _star(_star(edges, large=True), large=False)._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4
    written = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("lexhoard.graph.saved", lambda df: written.append(1) or saved(df))
        out = connected_components(edges.selectExpr("u AS src", "v AS dst"))
    assert {(r["node"], r["component"]) for r in out.collect()} == {(i + 100, i % 4) for i in range(40)} | {(i, i) for i in range(4)}
    assert len(written) == 3  # edges, one round, result


def test_joined_components_equal_components_of_all_edges(spark):
    """Further edges within a component, between components, to new nodes, to themselves and with null ends."""
    first = [(5, 4), (4, 9), (7, 8), (20, 21), (30, 31)]
    more = [(9, 5), (8, 9), (21, 100), (101, 102), (50, 50), (None, 4), (60, None), (30, 30), (3, 31)]
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    joined = joined_components(connected_components(table(first)), table(more))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, connected_components(table(first + more)).collect()))



def test_search_and_scope(spark):
    df = spark.createDataFrame([("1", "Élan of cells", ["k1"]), ("2", "crops", ["RNA"])], "id string, title string, keywords array<string>")
    assert [r["id"] for r in select.filter_records(df.withColumn("excluded", F.lit(False)).withColumn("relevance_score", F.lit(1.0)), text="ELAN, cell", when=F.lit(None).cast("date")).collect()] == ["1"]
    kept = select.apply_query_scope(df, ["rna"], ["crop", "plant"], fields=("title",)).collect()
    assert [(r["id"], r["exclusion_reasons"]) for r in kept] == [("2", ["matched exclusion term: crop"])]
    assert select.apply_query_scope(df, ["rna"], ["crop"], fields=("title",), spared=["crop"]).first()["excluded"] is False


def test_secrets(spark):
    df = spark.createDataFrame([(1, "API_KEY is the name"), (2, 'API_KEY = "abcdefghijklmnop1234"'), (3, "api_key: none"), (4, "ghp_" + "a" * 36)], "id int, t string")
    assert sorted((r["id"], r["label"]) for r in select.scan_secrets(df, "id", "t").collect()) == [(2, "assigned API key"), (4, "GitHub token")]


def test_update_takes_its_own_output(spark):
    authors = "array<struct<name:string,orcid:string,affiliations:array<string>>>"
    schema = f"id string, doi string, title string, abstract string, publisher string, source_types array<string>, keywords array<string>, authors {authors}, excluded boolean, updated_date date"
    ada = [("Ada Doe", "0000-1", ["Köln"])]
    row = lambda i, doi, pub, words: (str(i), doi, f"title {i} drug", "text", pub, ["pubmed"], words, ada if i == 5 else [], False, dt.date(2024, 2, i + 1))
    rows = [row(i, f"10.1/{i}", None, [f"k{i}"]) for i in range(9)]
    incoming = spark.createDataFrame([*rows, ("77", *row(7, "https://doi.org/10.1/6", "P", ["k6", "x"])[1:])], schema)
    roster = spark.createDataFrame([(1, 1, "0000-1", ["Ada Doe"], ["koln"], True, True)], "person long, position long, orcid string, aliases array<string>, affiliation_terms array<string>, require_affiliation boolean, active boolean")
    works = spark.createDataFrame([("10.1/3", "Press")], "doi string, publisher string")
    rules = [classify.Rule("topics", "d", [r"\bdrug\b"])]
    run = lambda existing, days=50, what=incoming: jobs.update(existing, what, roster, works, rules, "2024-02-09", days, F.col("updated_date"))
    first = run(None)
    assert first.report.first()["changed"] == 10 and first.report.first()["total"] == 9 and first.decisions.count() == 1
    out = {r["id"]: r for r in first.records.collect()}
    assert out["3"]["publisher"] == "Press" and out["5"]["authors"][0]["name"] == "Ada Doe" and len(out["5"]["watched_people"]) == 1
    both = out["doi:10.1/6"]
    assert both["keywords"] == ["k6", "x"] and both["publisher"] == "P" and both["n_members"] == 2 and both["cluster"] == "6 @pubmed"
    again = run(first.corpus)
    assert again.report.first()["changed"] == 0 and set(again.records.columns) == set(first.records.columns)
    assert {r["id"]: r for r in again.records.select(sorted(first.records.columns)).collect()} == {r["id"]: r for r in first.records.select(sorted(first.records.columns)).collect()}
    new = incoming.withColumn("abstract", F.when(F.col("id") == "4", "other").otherwise(F.col("abstract")))
    assert run(first.corpus, what=new).report.first()["changed"] == 1
    short = run(None, days=5)
    assert short.report.first()["removed"] == 4 and {r["id"] for r in short.records.collect()} == {"4", "5", "7", "8", "doi:10.1/6"}


def test_people_by_name_parts_and_record_affiliations(spark):
    author = "name:string,orcid:string,family_name:string,given_name:string,affiliations:array<string>"
    rows = [
        (1, [("Doe, Ada", None, "Doe", "Ada M.", ["Universität Köln"])], [], None),
        (2, [("Ada Doe", None, None, "", [])], [("Univ. Köln",)], None),
        (3, [("Ada Doe", None, None, None, None)], None, ["universitat-koln"]),
        (4, [("A. Doe", None, "Doe", "A.", ["Universitat Koln"])], [], None),
        (5, [("Ada Doe", None, None, None, ["Bonn"])], [], []),
        (6, [("X", "https://orcid.org/0000-1", None, None, [])], [], []),
        (7, [("Doe, Ada", None, None, None, ["Universitat Koln"])], [], []),
    ]
    records = spark.createDataFrame(rows, f"id long, authors array<struct<{author}>>, organizations array<struct<name:string>>, institutions array<string>")
    schema = "person string, position long, orcid string, aliases array<string>, affiliation_terms array<string>, require_affiliation boolean, active boolean"
    roster = spark.createDataFrame([("ada", 1, "0000-1", ["Áda Doe", "Doe"], ["Universitat Koln", "univ koln"], True, True), ("free", 2, None, ["Ada Doe"], [], False, True), ("none", 3, None, ["Ada Doe"], [], True, True), ("gone", 4, None, ["Ada Doe"], [], False, False)], schema)
    found = {(r["id"], r["person"]) for r in people.match_people(records, roster).collect()}
    assert found == {(i, "ada") for i in (1, 2, 3, 6)} | {(i, "free") for i in (1, 2, 3, 5)}


def test_rules_are_linear_in_hits(spark):
    df = spark.createDataFrame([("1", "", "Drug drug DRUG vaccine " * 20_000)], "id string, title string, abstract string")
    rule = classify.Rule("topics", "d", [r"\bvaccine\b", r"\bdrug\b"])
    e = classify.classify(df, [rule]).first()["classification_evidence"]["topics"][0]
    assert e["matched_phrases"] == ["vaccine", "Drug"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"t{i}", "x", False, float(i), dt.date(2024, 1, 1 + i), dt.datetime(2024, 1, 1)) for i in range(5)], "id string, title string, abstract string, excluded boolean, relevance_score double, d date, retrieved_at timestamp")
    jobs.export(df.orderBy("title"), str(tmp_path / "a"), ["title"], when=F.col("d"))
    jobs.export(df.repartition(3).orderBy(F.rand(1)), str(tmp_path / "b"), ["title"], when=F.col("d"))
    for part in ("records", "latest", "statistics", "facets", "last_updated"):
        read = lambda x: sorted(r["value"] for r in spark.read.text(str(tmp_path / x / part)).collect())  # noqa: B023, E731
        assert read("a") == read("b") != []


def test_validate(spark):
    df = spark.createDataFrame([("1", "publication", ["mRNA", "x"]), ("", "odd", []), ("1", "news", [])], "id string, record_type string, modalities array<string>")
    out = sorted((r["id"], r["field"], r["bad_values"]) for r in report.validate_records(df, unique=["id"]).collect())
    assert out == [("", "id", ["missing"]), ("", "record_type", ["odd"]), ("1", "id", ["1"]), ("1", "modalities", ["x"])]


def test_sequence_ratio_as_difflib():
    """Equal to difflib's, and quick on long titles of one repeated word, where its table of places is quadratic."""
    rng = random.Random(2)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("ab", "abcd ", "abcdefghéß "):
        for _ in range(400):
            a = of(letters, rng.randint(0, 60))
            b = of(letters, rng.randint(0, 60)) if rng.random() < 0.5 else (a[: len(a) // 2] + rng.choice(letters) + a[len(a) // 2 :]) * rng.randint(1, 3)
            other = difflib.SequenceMatcher(None, a, b, autojunk=False)
            assert text.matched_ratio(a, b) == other.ratio()
            assert 2 * text.common_length(a, b) >= round(other.ratio() * (len(a) + len(b)))
    assert text.common_length("abcde", "xbdey") == 3
    start = time.process_time()
    assert text.matched_ratio("thor " * 8000, "thor " * 8600) == 2 * 40000 / 83000
    assert time.process_time() - start < 10


def test_only_entities_go_to_python(spark):
    said = ["&notit; a &amp;amp; b", "x &#xFDD0;y &#65;&#66", "&foo﷐&eacute;", "&" + "a" * 40 + ";&euro;", "&frac12;", "no &ent here &#0; &#x80;", "&#10;&Tab;z&#55296;", "&eacute﷐;&copy", "a&#233;"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    out = df.select("id", text._decoded(F.col("t")).alias("t"))
    assert {r["id"]: r["t"] for r in out.collect()} == {i: html.unescape(t) for i, t in enumerate(said)}
    plan = text.html_to_text_whole(df, "t", None)._jdf.queryExecution().optimizedPlan().toString()
    assert "all_entities(array_join(regexp_extract_all(" in plan


def test_crossref_dates_are_read_once(spark):
    works = spark.createDataFrame([], f"{normalize.WORK_SCHEMA}, raw string")
    assert normalize.normalize_crossref(works, rejects=True)._jdf.queryExecution().optimizedPlan().toString().count("date-parts") <= 24
