"""From landed files of five sources to exported artifacts: normalize, update twice, score, export, validate."""

import json

from pyspark.sql import functions as F

from lexhoard.operators import classify, report, select
from lexhoard.plans import jobs
from lexhoard.sources import landing
from lexhoard.sources.records import as_records, union_records

RULES = [classify.Rule("modalities", "mRNA", [r"\bmRNA\b"]), classify.Rule("topics", "delivery", [r"\bdeliver\w*\b"])]


def _article(pmid, title, doi, year=2024):
    return f'<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><JournalIssue><PubDate><Year>{year}</Year><Month>02</Month></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>{title}</ArticleTitle><Abstract><AbstractText>mRNA drug in mice.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>Ada</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">{doi}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'


def _study(status, day):
    return json.dumps({"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "Trial of mRNA"}, "statusModule": {"overallStatus": status, "lastUpdatePostDateStruct": {"date": day}, "studyFirstPostDateStruct": {"date": "2024-01-01"}}, "designModule": {"phases": ["PHASE2"]}}})


def _landed(spark, folder, at, study):
    files = {
        "pubmed/a.xml": f"<S>{_article(1, 'Delivery of mRNA in mice', '10.1/J')}{_article(2, 'Another one', '10.1/K', 1990)}</S>",
        "clinicaltrials/a.json": study,
        "biorxiv/a.json": json.dumps({"collection": [{"doi": "10.9/P", "title": "Delivery of mRNA in mice (preprint)", "authors": "Doe, A.", "date": "2024-01-20", "version": "1", "published": "10.1/j", "category": "biology"}]}),
        "crossref/a.json": json.dumps({"message": {"DOI": "10.1/J", "title": ["Delivery of mRNA in mice"], "publisher": "Press", "issued": {"date-parts": [[2024, 2]]}}}),
    }
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text + "\n")
    tables = []
    for source in ("pubmed", "clinicaltrials", "biorxiv", "crossref"):
        path = str(folder / source)
        rows = landing.read_xml_rows(spark, path, "PubmedArticle") if source == "pubmed" else landing.read_json_rows(spark, path)
        records, rejected = landing.normalized(rows.withColumn("retrieved_at", F.lit(at).cast("timestamp")), source)
        assert rejected.count() == 0
        tables.append(records)
    (folder / "feed").mkdir(exist_ok=True)
    (folder / "feed" / "agency.xml").write_text("<rss><channel><item><guid>g</guid><title>mRNA drug approved</title><link>https://a.gov/1</link><pubDate>2024-02-10</pubDate></item></channel></rss>")
    feeds = spark.createDataFrame([("agency", "regulatory", "Agency")], "name string, source_type string, attribution string")
    items, _ = landing.normalized_feeds(landing.read_feed_rows(spark, str(folder / "feed")).withColumn("feed", F.lit("agency")).withColumn("retrieved_at", F.lit(at).cast("timestamp")), feeds)
    return union_records(*tables, items)


def test_five_sources_to_artifacts(spark, tmp_path):
    roster = spark.createDataFrame([("ada", 1, None, ["Ada Doe"], [], False, True)], "person string, position long, orcid string, aliases array<string>, affiliation_terms array<string>, require_affiliation boolean, active boolean")
    works = spark.createDataFrame([("10.1/j", "Press of works", "https://w")], "doi string, publisher string, url string")
    run = lambda corpus, incoming: jobs.update(corpus, incoming, roster, works, RULES, "2024-02-28", 60)
    first = run(None, _landed(spark, tmp_path / "1", "2024-02-20", _study("RECRUITING", "2024-02-01")))
    out = {r["id"]: r for r in first.records.collect()}
    # Article, preprint and work are one record; the old article is pruned.
    assert set(out) == {"doi:10.1/j", "nct:NCT1", "rss:g"} and first.report.first()["removed"] == 1
    r = out["doi:10.1/j"]
    assert r["n_members"] == 3 and sorted(r["source_types"]) == ["biorxiv", "crossref", "pubmed"] and r["relations"] == {"has-preprint": ["10.9/p"]} and r["watched_people"] == ["ada"]
    assert r["title"] == "Delivery of mRNA in mice" and r["abstract"] == "mRNA drug in mice." and r["publisher"] == "Press of works" and str(r["first_date"]) == "2024-01-20"
    assert {p["source"] for p in r["provenance"]} == {"pubmed", "biorxiv", "crossref"} and any(p["note"] and p["note"].startswith("merged: ") for p in r["provenance"])
    assert r["modalities"] == ["mRNA"] and r["topics"] == ["delivery"] and r["relevance_score"] == sum(c["points"] for c in r["score_components"]) > 30
    # The same again changes nothing; the trial's next snapshot becomes an event.
    again = run(first.corpus, _landed(spark, tmp_path / "2", "2024-02-21", _study("RECRUITING", "2024-02-01")))
    assert again.report.first()["changed"] == 1  # what was pruned comes again
    third = run(again.corpus, _landed(spark, tmp_path / "3", "2024-02-22", _study("COMPLETED", "2024-02-15")))
    t = {r["id"]: r for r in third.records.collect()}["nct:NCT1"]
    assert t["version"] == 2 and [e["fields"] for e in t["change_history"]] == [["trial.overall_status"]] and t["change_history"][0]["old_values"] == {"trial.overall_status": '{"value":"RECRUITING"}'}
    assert {"clinical status change": 8.0}.items() <= {c["name"]: c["points"] for c in t["score_components"]}.items() and len(t["provenance"]) == 2
    # Artifacts do not depend on order, and nothing in them is invalid.
    for name, table in (("a", third.records), ("b", third.records.orderBy(F.rand(3)).repartition(3))):
        jobs.export(table, str(tmp_path / name), ["record_type", "modalities", "source_types"])
    read = lambda x, part: sorted(r["value"] for r in spark.read.text(str(tmp_path / x / part)).collect())
    assert all(read("a", part) == read("b", part) != [] for part in ("records", "latest", "statistics", "facets", "last_updated"))
    assert jobs.validate(third.records, vocabularies=report.VOCABULARIES, required=["id", "title"]).count() == 0
    assert [r["views"] for r in select.matched_views(third.records.where("id = 'nct:NCT1'")).collect()] == [["mrna", "clinical", "trial-changes", "technology mRNA"]]


def test_as_records_fills_and_orders(spark):
    df = spark.sql("SELECT 'x' AS id, array(named_struct('name', 'A')) AS authors, 'gone' AS other, named_struct('server', 's', 'extra', 1) AS preprint")
    r = as_records(df).first()
    assert r["authors"][0].asDict() == {"name": "A", "given_name": None, "family_name": None, "orcid": None, "affiliations": None}
    assert (r["keywords"], r["source_ids"], r["excluded"], r["version"], r["trial"], r["preprint"]["server"]) == ([], {}, False, 1, None, "s") and "other" not in as_records(df).columns
