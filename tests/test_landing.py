"""Landed payloads: provenance and hashes, rejected rows, both feed dialects, numbered lines."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexhoard.sources import landing

AT = dt.datetime(2024, 3, 1)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_articles_keep_what_was_landed(spark, tmp_path):
    whole = '<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><JournalIssue><PubDate><Year>2024</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>A <i>b</i></ArticleTitle><AuthorList><Author><LastName>Doe</LastName><AffiliationInfo><Affiliation>Uni</Affiliation></AffiliationInfo></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/A</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'
    untitled = "<PubmedArticle><MedlineCitation><PMID>6</PMID></MedlineCitation></PubmedArticle>"
    broken = "<PubmedArticle><MedlineCitation><PMID>7</MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?>\n<PubmedArticleSet>\n{whole}\n{untitled}\n{broken}</PubmedArticleSet>\n")
    landed = landing.read_xml_rows(spark, str(tmp_path), "PubmedArticle").withColumn("retrieved_at", F.lit(AT))
    records, rejected = landing.normalized(landed, "pubmed")
    r = records.first()
    assert records.count() == 1 and r["source_ids"] == {"pubmed": "5"} and r["alternate_urls"] == ["https://doi.org/10.1/a"] and r["retrieved_at"] == AT
    p = r["provenance"][0]
    assert (p["source"], p["source_id"], p["url"], p["retrieved_at"], p["raw_sha256"]) == ("pubmed", "5", "https://pubmed.ncbi.nlm.nih.gov/5/", AT, _sha(whole))
    assert [tuple(o) for o in r["organizations"]] == [("Uni", "affiliation", None)] and r["date_precision"] == {"published_date": "year", "first_date": "year"} and r["field_sources"]["doi"] == "pubmed"
    assert {x["raw"]: (x["reason"], x["raw_sha256"]) for x in rejected.collect()} == {untitled: ("missing title", _sha(untitled)), broken: ("not well-formed", _sha(broken))}


def test_json_sources(spark, tmp_path):
    lines = {
        "clinicaltrials": ['{"protocolSection":{"identificationModule":{"nctId":"NCT1","briefTitle":"T"},"sponsorCollaboratorsModule":{"leadSponsor":{"name":"Acme"},"collaborators":[{"name":"Uni"}]}}}', '{"protocolSection":{}}', "{oops"],
        "crossref": ['{"message":{"DOI":"10.5/W","title":["A"],"issued":{"date-parts":[[2024]]},"funder":[{"name":"F","DOI":"10.9/f"}],"author":[{"family":"B","affiliation":[{"name":"U"}]}]}}', '{"message":{"title":["no doi"]}}', '{"message":{"DOI":[1}}'],
        "medrxiv": ['{"collection":[{"doi":"10.1/X","title":"T","date":"2024-01-02","author_corresponding":"Doe, A","author_corresponding_institution":"Uni","category":"c","published":"10.2/J"},{"title":"none"}]}', "[]x"],
    }
    out = {}
    for source, text in lines.items():
        (tmp_path / source).write_text("\n".join(text) + "\n\n")
        records, rejected = landing.normalized(landing.read_json_rows(spark, str(tmp_path / source)), source)
        (out[source],), reasons = records.collect(), {x["raw"]: x["reason"] for x in rejected.collect()}
        assert sorted(reasons.values()) == sorted([{"clinicaltrials": "missing nct_id, title", "crossref": "missing doi", "medrxiv": "missing doi"}[source], "not well-formed"])
    t, w, m = out["clinicaltrials"], out["crossref"], out["medrxiv"]
    assert t["provenance"][0]["raw_sha256"] == _sha(lines["clinicaltrials"][0]) and (t["companies"], t["institutions"]) == (["Acme"], ["Uni"])
    assert [tuple(f) for f in w["funders"]] == [("F", "funder", "https://doi.org/10.9/f")] and w["provenance"][0]["url"] == "https://api.crossref.org/works/10.5%2Fw" and w["url"] == "https://doi.org/10.5/w" and w["alternate_urls"] == [] and w["first_date"] == dt.date(2024, 1, 1)
    assert m["source_ids"] == {"medrxiv": "10.1/x"} and m["corresponding_author"] == "Doe, A" and m["keywords"] == ["c"] and m["alternate_urls"] == ["https://doi.org/10.1/x", "https://doi.org/10.2/j"] and m["provenance"][0]["raw_sha256"]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>not an item</title>
<item><guid isPermaLink="false">g1</guid><title>News &lt;b&gt;x&lt;/b&gt;</title><link>https://e.com/a</link><description><![CDATA[<p>Hi &amp; by</p>]]></description><dc:creator>Ada Doe</dc:creator><dc:identifier>doi:10.1000/Q1</dc:identifier><pubDate>Tue, 06 Feb 2024 10:00:00 GMT</pubDate></item>
<item><title>Older</title><link>http://e.com/b</link><pubDate>2023</pubDate><author>x@e.com (Bo)</author></item>
<item><title>Bad link</title><link>ftp://e.com</link></item><item><title>Broken</title><link>https://e.com</item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><id>tag:1</id><title type="html">Entry</title><link rel="self" href="https://e.org/self"/><link rel="alternate" href="https://e.org/1"/>
<author><name>Cy Roe</name><email>c@e.org</email></author><author><name>Di Poe</name></author><summary>S</summary><published>2024-02-01T10:00:00Z</published><updated>2024-02-03T10:00:00Z</updated></entry></feed>"""


def test_feeds_of_both_dialects(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RSS)
    (tmp_path / "two.xml").write_text(ATOM)
    landed = landing.read_feed_rows(spark, str(tmp_path)).withColumn("feed", F.regexp_extract("file", r"(\w+)\.xml$", 1)).withColumn("retrieved_at", F.lit(AT))
    feeds = spark.createDataFrame([("one", "regulatory", "Agency"), ("three", "news", None)], "name string, source_type string, attribution string")
    records, rejected = landing.normalized_feeds(landed, feeds)
    out = {r["title"]: r for r in records.collect()}
    assert set(out) == {"News x", "Older", "Entry"}
    a, b, c = out["News x"], out["Older"], out["Entry"]
    assert (a["id"], a["doi"], a["description"], a["record_type"], a["source_types"], a["publisher"], a["published_date"]) == ("doi:10.1000/q1", "10.1000/q1", "Hi & by", "regulatory", ["rss", "regulatory"], "Agency", dt.date(2024, 2, 6))
    assert [x["name"] for x in a["authors"]] == ["Ada Doe"] and [tuple(o)[:2] for o in a["organizations"]] == [("Agency", "publisher")] and a["source_ids"] == {"rss:one": "g1"}
    assert (b["id"], b["published_date"], b["date_precision"], [x["name"] for x in b["authors"]]) == ("rss:http://e.com/b", dt.date(2023, 1, 1), {"published_date": "year", "first_date": "year"}, ["x@e.com (Bo)"])
    assert (c["id"], c["url"], c["record_type"], c["published_date"], c["updated_date"], c["description"]) == ("rss:tag:1", "https://e.org/1", "news", dt.date(2024, 2, 1), dt.date(2024, 2, 3), "S")
    assert [x["name"] for x in c["authors"]] == ["Cy Roe", "Di Poe"] and c["organizations"] == [] and len(c["provenance"][0]["raw_sha256"]) == 64
    assert sorted(x["reason"] for x in rejected.collect()) == ["missing http(s) link", "not well-formed"]
    few, rejected = landing.normalized_feeds(landed, feeds, per_feed=1)
    assert {r["title"] for r in few.collect()} == {"News x", "Entry"} and rejected.count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f'{{"id": "{i}", "n": {i}}}' if i % 7 else "" for i in range(1, 400)]
    for at in (5, 250, 390):
        lines[at - 1] = f"{{bad {at}"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "r" / "b.jsonl").write_text('{"id": "x", "n": 1}\n{"id": 2, "n": "no number"}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, bad = landing.read_numbered(spark, str(tmp_path / "r"), "id string, n long")
        assert sorted((r["file"][-7:], r["line"], r["value"][:7]) for r in bad.collect()) == [("a.jsonl", 5, "{bad 5"), ("a.jsonl", 250, "{bad 25"), ("a.jsonl", 390, "{bad 39"), ("b.jsonl", 2, '{"id": ')]
        assert rows.count() == 399 - 399 // 7 - 3 + (250 % 7 == 0) + (5 % 7 == 0) + (390 % 7 == 0) + 1
        with pytest.raises(ValueError, match="a.jsonl, line 5"):
            landing.read_strict(spark, str(tmp_path / "r"), "id string, n long")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "r" / "a.jsonl").unlink()
    (tmp_path / "r" / "b.jsonl").write_text('{"id": "x", "n": 1}\n\n')
    assert landing.read_strict(spark, str(tmp_path / "r"), "id string, n long").count() == 1


def test_feed_files_are_read_by_many_tasks(spark, tmp_path):
    """Items are what one expression finds in the whole file, wherever splits fall, in both dialects, nested or never closed."""
    rng = random.Random(3)
    parts = ["<item>", "<item a='1'>", "<items>", "</item>", "</item>", "</item >", "<entry\n>", "<entry>", "</entry>", "</entry>", "<b>é</b>", "</", "item>", "\r\n", "x" * 40, "a & b", "<", " "]
    whole = re.compile(r"(?s)(<item[\s>].*?</item>|<entry[\s>].*?</entry>)")
    texts = {f"{i}.xml": "".join(rng.choices(parts, k=rng.choice([3, 30, 400]))) for i in range(40)}
    texts |= {"header.xml": "<feed><title>on <item> tags</title>" + "<entry>a</entry>" * 200, "cut.xml": "<item>1</item>" * 150 + "<item>2 <entry>3</entry> 4", "bare.xml": "item></item>", "empty.xml": "", "one.xml": "<item>" + "y</b>" * 2000 + "</item>"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bytes.xml").write_bytes(b"<item>\xff\xc3</item>")
    options = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("feeds", "")
        got = sorted((r["file"].rsplit("/", 1)[1], r["raw"]) for r in landing.read_feed_rows(spark, str(tmp_path)).collect())
        assert got == sorted([(name, raw) for name, text in texts.items() for raw in whole.findall(text)] + [("bytes.xml", "<item>��</item>")])
        spark.sparkContext.setJobGroup("large", "")
        assert landing.read_feed_rows(spark, str(tmp_path / "one.xml")).count() == 1
        told = spark.sparkContext.statusTracker()
        stages = [told.getStageInfo(s) for job in told.getJobIdsForGroup("large") for s in told.getJobInfo(job).stageIds]
        assert max(s.numTasks for s in stages if s) > 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
