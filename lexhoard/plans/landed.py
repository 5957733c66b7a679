"""Queries of the landed sources: payloads made of the given tables are written as files, read, normalized, and told with their rejects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.session import shared_dir, table
from lexhoard.sources import landing

_AT = "2024-03-01 00:00:00"


def _files(df: DataFrame) -> str:
    """Writes the column `raw` as lines of text files."""
    at = f"{shared_dir(df.sparkSession)}/lexhoard-landed-{uuid.uuid4().hex}"
    df.select("raw").write.text(at)
    return at


def _concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _json(c: str) -> Column:
    """A text as JSON."""
    said = F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(said, F.lit(6), F.length(said) - 6)


def _told(records: DataFrame, rejected: DataFrame, *more: Column) -> DataFrame:
    """Records by what their sources gave, and rejects by reason and hash."""
    p = F.get(F.col("provenance"), F.lit(0))
    abstract = F.col("abstract") if "abstract" in records.columns else F.col("description")
    rows = records.select("id", F.sha2("title", 256).alias("title"), F.sha2(abstract, 256).alias("body"), p["raw_sha256"].alias("raw_sha"), p["source_id"].alias("source_id"), p["url"].alias("source_url"), F.date_format(p["retrieved_at"], "yyyy-MM-dd").alias("at"), *more, F.lit("").alias("reason"))
    return rows.unionByName(rejected.select(F.col("raw_sha256").alias("raw_sha"), "reason"), allowMissingColumns=True)


_SAFE = "regexp_replace(coalesce(text, ''), '[<>&\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')"
_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_TITLE = _FLAT.format("split_part(x, chr(10), 1)")


def _plain_text() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[<>&\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def landed_pubmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").withColumn("x", _plain_text())
    raw = _concat("<PubmedArticle><MedlineCitation><PMID>", n, "</PMID><Article><Journal><JournalIssue><PubDate><Year>", (2000 + F.col("doc_id") % 24).cast("string"), "</Year></PubDate></JournalIssue><Title>", F.col("source"), "</Title></Journal><ArticleTitle>", F.split("x", "\n")[0],
                  "</ArticleTitle><Abstract><AbstractText>", F.col("x"), "</AbstractText></Abstract><AuthorList><Author><LastName>", F.col("lang"), "</LastName><AffiliationInfo><Affiliation>", F.col("source"), "</Affiliation></AffiliationInfo></Author></AuthorList></Article></MedlineCitation></PubmedArticle>")
    landed = landing.read_xml_rows(spark, _files(docs.select(raw.alias("raw"))), "PubmedArticle").withColumn("retrieved_at", F.lit(_AT).cast("timestamp"))
    records, rejected = landing.normalized(landed, "pubmed")
    return _told(records, rejected, F.col("first_date").cast("string").alias("day"), F.get(F.col("authors"), F.lit(0))["name"].alias("author"), F.get(F.col("organizations"), F.lit(0))["name"].alias("organization"), F.col("date_precision")["first_date"].alias("precision"))


_PUBMED_RAW = """'<PubmedArticle><MedlineCitation><PMID>' || doc_id || '</PMID><Article><Journal><JournalIssue><PubDate><Year>' || (2000 + doc_id % 24) || '</Year></PubDate></JournalIssue><Title>' || source || '</Title></Journal><ArticleTitle>' || split_part(x, chr(10), 1) || '</ArticleTitle><Abstract><AbstractText>' || x || '</AbstractText></Abstract><AuthorList><Author><LastName>' || lang || '</LastName><AffiliationInfo><Affiliation>' || source || '</Affiliation></AffiliationInfo></Author></AuthorList></Article></MedlineCitation></PubmedArticle>'"""


def _sql(raw: str, columns: str, more: str, ok: str, missing: str = "missing title") -> str:
    """Rows of `_told` from documents: columns for records that `ok`, nulls and a reason for the rest."""
    names = [c.rsplit(" AS ", 1)[1] for c in f"{columns}{more}".split(" ;; ")]
    cells = [c.rsplit(" AS ", 1) for c in f"{columns}{more}".split(" ;; ")]
    picked = ", ".join(f"CASE WHEN {ok} THEN {value} END AS {name}" for value, name in cells)
    assert len(set(names)) == len(names)
    return f"WITH d AS (SELECT *, {_SAFE} AS x FROM documents), t AS (SELECT *, {_TITLE} AS title, {raw} AS raw FROM d) SELECT {picked}, sha256(raw) AS raw_sha, '2024-03-01' AS at_, CASE WHEN {ok} THEN '' ELSE '{missing}' END AS reason FROM t"


def _at(sql: str, ok: str) -> str:
    return sql.replace("'2024-03-01' AS at_", f"CASE WHEN {ok} THEN '2024-03-01' END AS \"at\"")


def landed_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").withColumn("x", _plain_text()).withColumn("title", F.trim(F.regexp_replace(F.split("x", "\n")[0], r"(?U)\s+", " ")))
    raw = _concat('{"protocolSection":{"identificationModule":{"nctId":"nct', n, '","briefTitle":', _json("title"), '},"statusModule":{"lastUpdatePostDateStruct":{"date":"2024-', F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), '"}},"sponsorCollaboratorsModule":{"leadSponsor":{"name":"', F.col("source"), '"},"collaborators":[{"name":"', F.col("lang"), '"}]},"descriptionModule":{"briefSummary":', _json("x"), '},"designModule":{"phases":["PHASE', (F.col("doc_id") % 3 + 1).cast("string"), '"]}}}')
    landed = landing.read_json_rows(spark, _files(docs.select(raw.alias("raw")))).withColumn("retrieved_at", F.lit(_AT).cast("timestamp"))
    records, rejected = landing.normalized(landed, "clinicaltrials")
    return _told(records, rejected, F.col("updated_date").cast("string").alias("day"), F.array_join("companies", ",").alias("companies"), F.array_join("institutions", ",").alias("institutions"), F.array_join("development_stages", ",").alias("stages"), F.col("date_precision")["updated_date"].alias("precision"))


_TRIAL_RAW = """'{"protocolSection":{"identificationModule":{"nctId":"nct' || doc_id || '","briefTitle":' || to_json(title) || '},"statusModule":{"lastUpdatePostDateStruct":{"date":"2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '"}},"sponsorCollaboratorsModule":{"leadSponsor":{"name":"' || source || '"},"collaborators":[{"name":"' || lang || '"}]},"descriptionModule":{"briefSummary":' || to_json(x) || '},"designModule":{"phases":["PHASE' || (doc_id % 3 + 1) || '"]}}}'"""


def landed_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").withColumn("x", _plain_text()).withColumn("title", F.trim(F.regexp_replace("x", r"(?U)\s+", " ")))
    raw = _concat('{"message":{"DOI":"10.1000/A/', n, '","title":[', _json("title"), '],"publisher":"', F.col("source"), '","issued":{"date-parts":[[2024,', (F.col("doc_id") % 12 + 1).cast("string"), ']]},"funder":[{"name":"', F.col("lang"), '","DOI":"10.9/', n, '"}],"author":[{"family":"Doe","given":"A","affiliation":[{"name":"', F.col("source"), '"}]}],"relation":{"cites":[{"id":"10.8/', n, '"}]}}}')
    landed = landing.read_json_rows(spark, _files(docs.select(raw.alias("raw")))).withColumn("retrieved_at", F.lit(_AT).cast("timestamp"))
    records, rejected = landing.normalized(landed, "crossref")
    funder = F.get(F.col("funders"), F.lit(0))
    return _told(records.withColumn("abstract", F.lit(None).cast("string")), rejected, F.col("first_date").cast("string").alias("day"), F.concat_ws(" ", funder["name"], funder["ror_id"]).alias("funder"), F.array_join(F.col("relations")["cites"], ",").alias("cites"), F.array_join("institutions", ",").alias("institutions"), F.col("date_precision")["published_date"].alias("precision"))


_CROSSREF_RAW = """'{"message":{"DOI":"10.1000/A/' || doc_id || '","title":[' || to_json(title) || '],"publisher":"' || source || '","issued":{"date-parts":[[2024,' || (doc_id % 12 + 1) || ']]},"funder":[{"name":"' || lang || '","DOI":"10.9/' || doc_id || '"}],"author":[{"family":"Doe","given":"A","affiliation":[{"name":"' || source || '"}]}],"relation":{"cites":[{"id":"10.8/' || doc_id || '"}]}}}'"""


def landed_preprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten items."""
    n = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").withColumn("x", _plain_text()).withColumn("title", F.trim(F.regexp_replace(F.split("x", "\n")[0], r"(?U)\s+", " ")))
    item = _concat('{"doi":"10.1101/', n, '","title":', _json("title"), ',"authors":"Doe, A.; Roe, B.","author_corresponding_institution":"', F.col("source"), '","date":"2024-02-', F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), '","version":"2","category":"', F.col("lang"), '","abstract":', _json("x"), ',"published":"', F.when(F.col("doc_id") % 2 == 0, "NA").otherwise(_concat("10.2/", n)), '"}')
    pages = docs.select(F.floor(F.col("doc_id") / 10).alias("page"), item.alias("item")).groupBy("page").agg(_concat('{"collection":[', F.array_join(F.collect_list("item"), ","), "]}").alias("raw"))
    landed = landing.read_json_rows(spark, _files(pages)).withColumn("retrieved_at", F.lit(_AT).cast("timestamp"))
    records, rejected = landing.normalized(landed, "biorxiv")
    more = [F.col("first_date").cast("string").alias("day"), F.array_join("institutions", ",").alias("institutions"), F.array_join("keywords", ",").alias("keywords"), F.array_join("alternate_urls", " ").alias("urls"), F.col("preprint.publication_status").alias("status")]
    return _told(records, rejected, *more).drop("raw_sha")


#: An item's hash is over Spark's own text of it, so it isn't compared.
_PREPRINTS = f"""WITH d AS (SELECT *, {_SAFE} AS x FROM documents), t AS (SELECT *, {_TITLE} AS title FROM d), o AS (SELECT *, title <> '' AS ok FROM t)
SELECT CASE WHEN ok THEN 'doi:10.1101/' || doc_id END AS id, CASE WHEN ok THEN sha256(title) END AS title, CASE WHEN ok THEN sha256(x) END AS body, CASE WHEN ok THEN '10.1101/' || doc_id END AS source_id, CASE WHEN ok THEN 'https://www.biorxiv.org/content/10.1101/' || doc_id || 'v2' END AS source_url,
CASE WHEN ok THEN '2024-03-01' END AS "at", CASE WHEN ok THEN '2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS day, CASE WHEN ok THEN source END AS institutions, CASE WHEN ok THEN lang END AS keywords,
CASE WHEN ok THEN 'https://doi.org/10.1101/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' https://doi.org/10.2/' || doc_id END END AS urls, CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN 'preprint' ELSE 'published' END END AS status, CASE WHEN ok THEN '' ELSE 'missing title' END AS reason FROM o"""


def landed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the pages as RSS items, half as Atom entries, of two feeds; every fifth has a link that is none."""
    n, url = F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, F.lit("ftp://x")).otherwise(F.col("url"))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"[<>&\x00-\x1F]", " ")
    rss = _concat("<item><guid>g", n, "</guid><title>Page ", n, "</title><link>", F.replace(url, F.lit("&"), F.lit("&amp;")), "</link><description>", text, "</description><dc:creator>By ", n, "</dc:creator><pubDate>Tue, 06 Feb 2024 10:00:00 GMT</pubDate></item>")
    atom = _concat("<entry><id>g", n, '</id><title>Page ', n, '</title><link rel="alternate" href="', F.replace(url, F.lit("&"), F.lit("&amp;")), '"/><summary>', text, "</summary><author><name>By ", n, "</name></author><updated>2024-02-07T10:00:00Z</updated></entry>")
    pages = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("raw"))
    landed = landing.read_feed_rows(spark, _files(pages)).withColumn("retrieved_at", F.lit(_AT).cast("timestamp")).withColumn("feed", F.when(F.startswith("raw", F.lit("<item")), "even").otherwise("odd"))
    feeds = spark.createDataFrame([("even", "regulatory", "Agency")], "name string, source_type string, attribution string")
    records, rejected = landing.normalized_feeds(landed, feeds)
    more = [F.col("first_date").cast("string").alias("day"), "record_type", F.array_join("source_types", ",").alias("sources"), F.get(F.col("authors"), F.lit(0))["name"].alias("author"), "publisher", "url"]
    return _told(records, rejected, *more).drop("raw_sha")


_FEEDS = """WITH t AS (SELECT *, page_id % 5 <> 0 AS ok, page_id % 2 = 0 AS even, trim(regexp_replace(regexp_replace(coalesce(html, ''), '[<>&\\x00-\\x1F]', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM pages),
p AS (SELECT *, CASE WHEN b = '' THEN NULL WHEN length(b) > 1200 THEN rtrim(substr(b, 1, 1199)) || '…' ELSE b END AS body_ FROM t)
SELECT CASE WHEN ok THEN 'rss:g' || page_id END AS id, CASE WHEN ok THEN sha256('Page ' || page_id) END AS title, CASE WHEN ok THEN sha256(body_) END AS body, CASE WHEN ok THEN 'g' || page_id END AS source_id, CASE WHEN ok THEN url END AS source_url, CASE WHEN ok THEN '2024-03-01' END AS "at",
CASE WHEN ok THEN CASE WHEN even THEN '2024-02-06' ELSE '2024-02-07' END END AS day, CASE WHEN ok THEN CASE WHEN even THEN 'regulatory' ELSE 'news' END END AS record_type, CASE WHEN ok THEN CASE WHEN even THEN 'rss,regulatory' ELSE 'rss,news' END END AS sources, CASE WHEN ok THEN 'By ' || page_id END AS author,
CASE WHEN ok AND even THEN 'Agency' END AS publisher, CASE WHEN ok THEN url END AS url, CASE WHEN ok THEN '' ELSE 'missing http(s) link' END AS reason FROM p"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, every 50th cut short; each bad line is found under its number, which its file's other lines give."""
    docs = table(spark, sf_dir, "documents")
    said = F.to_json(F.struct("doc_id", "text"))
    at = f"{shared_dir(spark)}/lexhoard-landed-{uuid.uuid4().hex}"
    lines = docs.withColumn("raw", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("{cut "), F.col("doc_id").cast("string"))).otherwise(said))
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("raw").write.text(at)
    rows, bad = landing.read_numbered(spark, at, "doc_id long, text string")
    good = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.lit("row").alias("kind"))
    return good.unionByName(bad.where("line > 0").select(F.regexp_extract("value", "[0-9]+", 0).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("sha"), F.lit("bad").alias("kind")))


QUERIES = {"landed_pubmed": landed_pubmed, "landed_trials": landed_trials, "landed_crossref": landed_crossref, "landed_preprints": landed_preprints, "landed_feeds": landed_feeds, "numbered_lines": numbered_lines}
SQL = {
    "landed_pubmed": _at(_sql(_PUBMED_RAW, f"'pmid:' || doc_id AS id ;; sha256(title) AS title ;; sha256(nullif({_FLAT.format('x')}, '')) AS body ;; CAST(doc_id AS VARCHAR) AS source_id ;; 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS source_url", " ;; (2000 + doc_id % 24) || '-01-01' AS day ;; lang AS author ;; source AS organization ;; 'year' AS precision", "title <> ''"), "title <> ''"),
    "landed_trials": _at(_sql(_TRIAL_RAW, "'nct:NCT' || doc_id AS id ;; sha256(title) AS title ;; sha256(x) AS body ;; 'NCT' || doc_id AS source_id ;; 'https://clinicaltrials.gov/study/NCT' || doc_id AS source_url", " ;; '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS day ;; source AS companies ;; lang AS institutions ;; 'Phase ' || (doc_id % 3 + 1) AS stages ;; 'month' AS precision", "title <> ''"), "title <> ''"),
    "landed_crossref": _at(_sql(_CROSSREF_RAW, "'doi:10.1000/a/' || doc_id AS id ;; sha256(title) AS title ;; NULL AS body ;; '10.1000/a/' || doc_id AS source_id ;; 'https://api.crossref.org/works/10.1000%2Fa%2F' || doc_id AS source_url", " ;; '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS day ;; lang || ' https://doi.org/10.9/' || doc_id AS funder ;; '10.8/' || doc_id AS cites ;; source AS institutions ;; 'month' AS precision", "title <> ''"), "title <> ''").replace(_TITLE + " AS title", _FLAT.format("x") + " AS title"),
    "landed_preprints": _PREPRINTS,
    "landed_feeds": _FEEDS,
    "numbered_lines": "SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN sha256(coalesce(text, '')) END AS sha, CASE WHEN doc_id % 50 = 0 THEN 'bad' ELSE 'row' END AS kind FROM documents",
}
