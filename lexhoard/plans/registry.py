"""Queries of the library by name, over the given tables, with the SQL they are held against.

The tables have no titles, DOIs or authors, so `records` binds documents to record columns: title is the first line, the abstract
the whole text, dates, scores and labels follow from doc_id and the words of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.functions import dates, ids, text
from lexhoard.operators import classify, dedup, history, index, people, report, select
from lexhoard.plans import jobs, landed, streams, views
from lexhoard.session import shared_dir, table

AS_OF, LATER = "2024-02-15", "2024-03-15"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    has = lambda word: F.contains(F.lower(body), F.lit(word))
    labels = lambda **of: F.filter(F.array(*[F.when(has(w), F.lit(label)) for label, w in of.items()]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        F.split(body, "\n")[0].alias("title"),
        body.alias("abstract"),
        F.array("source").alias("source_types"),
        "source",
        "lang",
        F.when(F.col("lang") == "de", "preprint").when(F.col("lang") == "fr", "clinical_trial").otherwise("publication").alias("record_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("updated_date"),
        (F.col("doc_id") * 37 % 101).cast("double").alias("relevance_score"),
        (F.col("doc_id") % 13 == 0).alias("excluded"),
        labels(mRNA="license", siRNA="token").alias("modalities"),
        labels(delivery="http", CRISPR="benchmark").alias("topics"),
    )


#: The same view for the SQL side; `day` is the date as text.
R = """r AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, split_part(text, chr(10), 1) AS title, text AS abstract, source, lang,
CASE lang WHEN 'de' THEN 'preprint' WHEN 'fr' THEN 'clinical_trial' ELSE 'publication' END AS record_type,
CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS VARCHAR) AS day, CAST(doc_id * 37 % 101 AS DOUBLE) AS score, doc_id % 13 = 0 AS excluded,
list_filter([CASE WHEN contains(lower(text), 'license') THEN 'mRNA' END, CASE WHEN contains(lower(text), 'token') THEN 'siRNA' END], lambda x: x IS NOT NULL) AS modalities,
contains(lower(text), 'benchmark') AS crispr, contains(lower(text), 'http') AS delivery FROM documents)"""


def updated() -> Column:
    """The record view's date. Made on call: Columns need a session."""
    return F.col("updated_date")



RULES = [
    classify.Rule("topics", "terms", [r"\blicen[sc]ed?\b", r"\btoken\b"], minimum_score=1.0),
    classify.Rule("topics", "insult", [r"\b(?:idiot|moron|clown)\b"], [r"\bapache\b"], weight=2.0, minimum_score=2.0),
    classify.Rule("methods", "common", [r"\bthe\b"], minimum_score=20.0),
]
WEIGHTS = {"title": 3.0, "abstract": 1.0}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, classify, score, and count facets."""
    scoped = select.apply_query_scope(records(spark, sf_dir), ["the", "der", "que"], ["idiot"], keywords=None)
    scored = classify.score(classify.classify(scoped, RULES, WEIGHTS), AS_OF, updated())
    return report.facets(scored, ["record_type", "source_types", "topics", "methods", "modalities"])


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, '10.1000/' || doc_id AS doi, '10.1000/' || doc_id || '.x' AS found FROM documents")
def normalize_doi(spark, sf):
    raw = F.concat(F.lit(" https://DOI.org/10.1000/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", text.normalize_doi(F.concat(raw, F.lit(". "))).alias("doi"), text.extract_doi(F.lit("none"), F.concat(raw, F.lit(".X) "))).alias("found"))


@query(f"WITH {R} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '\\b(version\\s*|v)\\d+\\b', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM r")
def normalize_title(spark, sf):
    return records(spark, sf).select("doc_id", text.normalize_title(F.col("title")).alias("title"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'doi:10.1000/' || doc_id WHEN 1 THEN 'pmid:' || doc_id WHEN 2 THEN 'nct:NCT' || doc_id ELSE source || ':' || doc_id END AS id FROM documents")
def canonical_id(spark, sf):
    d = F.col("doc_id").cast("string")
    of = lambda i, c: F.when(F.col("doc_id") % 4 == i, c)
    none = F.lit(None).cast("string")
    return table(spark, sf, "documents").select("doc_id", ids.canonical_id(of(0, F.concat(F.lit("doi: 10.1000/"), d)), of(1, d), of(2, F.concat(F.lit("nct"), d)), F.col("source"), d, none, none, none).alias("id"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision FROM orders""")
def parse_flexible_date(spark, sf):
    made = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'about' yyyy 'or so'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MMM")).otherwise(F.date_format("o_orderdate", "yyyy/MM/d"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_flexible_date(made).alias("d")).select("o_orderkey", F.col("d.value").cast("string").alias("value"), "d.precision")


_TAGS = "regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script\\s*>', ' ', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', ' ', 'gis'), '<!--.*?-->|<[^>]*>', ' ', 'gs')"
_ENTITIES = _TAGS
for _e, _c in text.ENTITIES:
    _ENTITIES = "replace({}, '{}', '{}')".format(_ENTITIES, _e, _c.replace("'", "''"))


@query(f"WITH t AS (SELECT page_id, trim(regexp_replace({_ENTITIES}, '\\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 300 THEN rtrim(substr(t, 1, 299)) || '…' ELSE t END AS text FROM t")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html"), 300).alias("text"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'é“' WHEN 1 THEN 'A½' ELSE '<p>' END || trim(regexp_replace(regexp_replace(html, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text_whole(spark, sf):
    """Pages behind numeric references and rare names."""
    head = F.when(F.col("page_id") % 3 == 0, "<b>&#233;&#x201C;</b>").when(F.col("page_id") % 3 == 1, "&#65;&frac12;").otherwise("&lt;p&gt;")
    made = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace(head, "</?b>", ""), F.trim(F.regexp_replace("html", "[<>&]", " "))).alias("text"))
    return text.html_to_text_whole(made, "text", None)


@query(f"WITH {R} SELECT doc_id, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS name FROM r")
def ascii_fold(spark, sf):
    return records(spark, sf).select("doc_id", text.ascii_fold(F.col("title")).alias("name"))


@query(f"""WITH {R}, w AS (SELECT doc_id, list_filter(list_distinct(string_split(lower(title), ' ')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split(lower(split_part(abstract, chr(10), 2)), ' ')), lambda x: x <> '') AS b FROM r)
SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END AS jaccard FROM w""")
def token_jaccard(spark, sf):
    second = F.coalesce(F.get(F.split("abstract", "\n"), F.lit(1)), F.lit(""))
    return records(spark, sf).select("doc_id", text.token_jaccard(F.lower("title"), F.lower(second)).alias("jaccard"))


@query()
def sequence_ratio(spark, sf):
    second = F.coalesce(F.get(F.split("abstract", "\n"), F.lit(1)), F.lit(""))
    return records(spark, sf).select("doc_id", text.sequence_ratio(F.col("title"), second).alias("ratio"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html, CASE WHEN url LIKE 'http%' THEN url END AS url FROM pages")
def escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.escape_html(F.col("html")).alias("html"), text.safe_url(F.col("url")).alias("url"))


@query("SELECT doc_id, CASE WHEN length(text) > 360 THEN substr(text, 1, 357) || '…' WHEN text = '' THEN NULL ELSE text END AS snippet FROM documents")
def snippet(spark, sf):
    return records(spark, sf).select("doc_id", text.snippet(F.lit(""), F.col("abstract")).alias("snippet"))


@query("""SELECT doc_id, 'https://doi.org/10.1000/' || doc_id || ' https://api.crossref.org/works/10.1000%2F' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' ELSE '' END AS urls FROM documents""")
def identifier_urls(spark, sf):
    d = F.col("doc_id").cast("string")
    urls = ids.identifier_urls(F.concat(F.lit("10.1000/"), d), F.when(F.col("doc_id") % 2 == 0, d), F.lit(None).cast("string"))
    order = F.filter(urls, lambda u: ~F.contains(u, F.lit("pubmed")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.concat(order, F.array_except(urls, order)), " ").alias("urls"))


@query("SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Phase 1' WHEN '2' THEN 'Phase 2' WHEN '3' THEN 'Phase 3' ELSE 'unknown' END AS label FROM orders")
def phase_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ids.phase_label(F.concat(F.lit("phase"), F.substring("o_orderpriority", 1, 1))).alias("label"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def raw_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.raw_sha256(F.col("text")).alias("sha"))


@query("SELECT doc_id, lang || ',' || source AS union_, 'a=' || lang || '|' || source || ';b=' || lang AS map_ FROM documents")
def array_union_ordered(spark, sf):
    joined = ids.map_union_arrays(F.create_map(F.lit("a"), F.array("lang")), F.create_map(F.lit("a"), F.array("source", "lang"), F.lit("b"), F.array("lang")))
    said = F.array_join(F.transform(F.array_sort(F.map_entries(joined)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
    return table(spark, sf, "documents").select("doc_id", F.array_join(ids.array_union_ordered(F.array("lang", F.lit("")), F.array("source", "lang")), ",").alias("union_"), said.alias("map_"))


# --- filters, search, order -----------------------------------------------------------------------------------------------


@query(f"""WITH {R} SELECT doc_id, excluded OR contains(lower(abstract), 'idiot') OR contains(lower(abstract), 'license') AS excluded,
array_to_string(list_filter([CASE WHEN contains(lower(abstract), 'idiot') THEN 'matched exclusion term: idiot' END, CASE WHEN contains(lower(abstract), 'license') THEN 'matched exclusion term: license' END], lambda x: x IS NOT NULL), ';') AS reasons
FROM r WHERE contains(lower(abstract), 'the ') OR contains(lower(abstract), 'der ')""")
def apply_query_scope(spark, sf):
    return select.apply_query_scope(records(spark, sf), ["the ", "Der "], ["license", "idiot"], keywords=None).select("doc_id", "excluded", F.array_join("exclusion_reasons", ";").alias("reasons"))


@query(f"WITH {R} SELECT doc_id FROM r WHERE (regexp_matches(lower(abstract), '\\bthe\\b') AND regexp_matches(lower(abstract), '\\blicense\\b') OR regexp_matches(lower(abstract), '\\btoken\\b')) AND day BETWEEN '2024-01-10' AND '2024-02-10'")
def discovery_filter(spark, sf):
    return select.discovery_filter(records(spark, sf), [["the", "license"], ["token"]], "2024-01-10", "2024-02-10", F.col("abstract"), "updated_date", "updated_date").select("doc_id")


@query(f"WITH {R} SELECT doc_id FROM r WHERE contains(lower(abstract), 'der ') AND lang = 'de' AND day BETWEEN '2024-01-10' AND '2024-02-10'")
def trial_filter(spark, sf):
    df = records(spark, sf).withColumn("study_type", F.when(F.col("lang") == "de", "Interventional").otherwise("Observational"))
    return select.trial_filter(df, ["der "], "2024-01-10", "2024-02-10", F.col("abstract")).select("doc_id")


@query(f"WITH {R} SELECT doc_id FROM r WHERE doc_id % 7 = 0 OR day BETWEEN '2024-02-01' AND '2024-02-10'")
def window_filter(spark, sf):
    df = records(spark, sf).withColumn("d", F.when(F.col("doc_id") % 7 != 0, F.col("updated_date")))
    return select.window_filter(df, "2024-02-01", "2024-02-10", "d").select("doc_id")


@query(f"WITH {R} SELECT doc_id FROM r WHERE day BETWEEN '2024-01-17' AND '{AS_OF}'")
def retain_recent(spark, sf):
    return select.retain_recent(records(spark, sf), AS_OF, 30, updated()).select("doc_id")


@query(f"WITH {R} SELECT doc_id FROM r WHERE day BETWEEN '2024-02-09' AND '{AS_OF}'")
def last_days(spark, sf):
    return select.last_days(records(spark, sf), AS_OF, 7, "updated_date").select("doc_id")


@query(f"WITH {R}, t AS (SELECT *, regexp_replace(lower(strip_accents(title || ' ' || abstract)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS h FROM r) SELECT doc_id FROM t WHERE NOT excluded AND contains(h, 'the') AND contains(h, 'er') AND score >= 20 AND day >= '2024-01-05' AND day <= '2024-02-20'")
def filter_records(spark, sf):
    return select.filter_records(records(spark, sf), text="THÉ er", min_score=20, date_from="2024-01-05", date_to="2024-02-20", when=updated()).select("doc_id")


@query(f"WITH {R} SELECT doc_id FROM r WHERE NOT excluded AND lang = 'en' AND source = 'src0' AND list_contains(modalities, 'mRNA')")
def filter_records_by_facets(spark, sf):
    return select.filter_records(records(spark, sf), equal={"lang": "en"}, member={"source_types": "src0"}, tech="mRNA", when=updated()).select("doc_id")


_HAY = "regexp_replace(lower(strip_accents(title || ' ' || abstract)), '[^\\p{L}\\p{N}]+', ' ', 'g')"
_SEARCHES = {"two terms": "Licénse MIT", "short term": "permission of", "rare": "benchmark", "none": "qqqzzz license", "only short": "a e", "no term": "--"}


@query(f"WITH {R}, t AS (SELECT doc_id, {_HAY} AS h FROM r) " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS search FROM t WHERE " + (" AND ".join(f"contains(h, '{t}')" for t in index.query_terms(q)) or "true") for name, q in _SEARCHES.items()))
def search_indexed(spark, sf):
    """Several searches of one index over all documents."""
    at = f"{shared_dir(spark)}/lexhoard-index-{uuid.uuid4().hex}"
    hay = text.search_normalize(F.concat_ws(" ", "title", "abstract"))
    index.write_search_index(records(spark, sf).select("doc_id", hay.alias("search_text")), at, "doc_id")
    found = [index.search_indexed(spark, at, q).select(F.col("id").alias("doc_id"), F.lit(name).alias("search")) for name, q in _SEARCHES.items()]
    return select.union_sources(*found)


@query(f"WITH {R} SELECT doc_id FROM r WHERE list_contains(modalities, 'mRNA')")
def technology_filter(spark, sf):
    return select.technology_filter(records(spark, sf), "mRNA").select("doc_id")


@query(f"WITH {R} SELECT doc_id, 'sirna' AS view FROM r WHERE list_contains(modalities, 'siRNA') UNION ALL SELECT doc_id, 'crispr' FROM r WHERE crispr UNION ALL SELECT doc_id, 'all' FROM r")
def preset_filter(spark, sf):
    df = records(spark, sf)
    made = [select.preset_filter(df, name).select("doc_id", F.lit(name).alias("view")) for name in ("sirna", "crispr", "all")]
    return select.union_sources(*made)


def _organized(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "affiliation").otherwise("sponsor")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(" University"))).otherwise(F.concat("source", F.lit(" Pharma Inc")))
    none = F.array().cast("array<string>")
    return records(spark, sf).withColumn("organizations", F.array(F.struct(name.alias("name"), kind.alias("organization_type")))).withColumn("companies", none).withColumn("institutions", none)


@query("SELECT doc_id, doc_id % 2 = 1 AS industry, doc_id % 6 = 0 AS academic FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0")
def industry_academic_filter(spark, sf):
    return _organized(spark, sf).where(select.industry() | select.academic()).select("doc_id", select.industry().alias("industry"), select.academic().alias("academic"))


@query("SELECT doc_id AS id, 'assigned token' AS label FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{40}\"')")
def scan_secrets(spark, sf):
    return select.scan_secrets(table(spark, sf, "documents"), "doc_id", "text", select.SECRETS | {"assigned token": 'token = "[0-9a-f]{40}"'})


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing lang' ELSE '' END AS reason FROM documents")
def split_valid(spark, sf):
    df = table(spark, sf, "documents").withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    good, bad = select.split_valid(df, ["doc_id", "lang"])
    return good.select("doc_id", F.lit("").alias("reason")).union(bad.select("doc_id", "reason"))


@query(f"WITH {R} SELECT doc_id, day, score FROM r WHERE NOT excluded ORDER BY day DESC, score DESC, id LIMIT 100")
def latest(spark, sf):
    return select.latest(records(spark, sf), 100, updated()).select("doc_id", updated().cast("string").alias("day"), F.col("relevance_score").alias("score"))


@query(f"WITH {R} SELECT doc_id, score FROM r ORDER BY score DESC, day DESC, id LIMIT 25 OFFSET 25")
def sort_and_page(spark, sf):
    return select.page(select.sort_records(records(spark, sf), "score-desc", updated()), 1).select("doc_id", F.col("relevance_score").alias("score"))


@query(f"WITH {R} SELECT doc_id, source FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY day DESC, doc_id) <= 3")
def limit_per_source(spark, sf):
    return select.limit_per_source(records(spark, sf), 3, "source", [updated().desc(), F.col("doc_id")]).select("doc_id", "source")


@query(f"WITH {R} SELECT day AS date, title, array_to_string(modalities, '; ') AS modalities, score AS relevance_score FROM r")
def flat_view(spark, sf):
    return select.flat_view(records(spark, sf), updated()).select("date", "title", "modalities", "relevance_score")


@query("SELECT doc_id AS key, 'documents' AS origin FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def union_sources(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.lit("documents").alias("origin"))
    return select.union_sources(a, table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("key")))


@query("SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1")
def distinct_ids(spark, sf):
    return select.distinct_ids(table(spark, sf, "events"), "user_id", "event_id")


# --- people, metadata, change detection --------------------------------------------------------------------------------------


def _authors(spark, sf):
    none = F.lit(None).cast("string")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    n = F.col("c_custkey")
    family = F.replace("c_name", F.lit("#"), F.lit(""))
    author = F.struct(
        F.when(n % 4 == 0, F.concat(family, F.lit(", A."))).otherwise(F.concat(F.lit("Anna K. "), family)).alias("name"),
        F.when(n % 4 == 0, family).alias("family_name"),
        F.when(n % 4 == 0, "ANNA K.").alias("given_name"),
        F.when(n % 50 == 0, F.concat(F.lit("https://orcid.org/0000-"), n.cast("string"))).otherwise(none).alias("orcid"),
        F.when(n % 3 != 0, F.array("n_name")).alias("affiliations"),
    )
    institutions, organizations = F.when(n % 6 == 3, F.array("n_name")), F.when(n % 6 == 0, F.array(F.struct(F.col("n_name").alias("name"))))
    return table(spark, sf, "customer").join(nation, "c_nationkey").select(n.alias("id"), "c_nationkey", F.array(author).alias("authors"), institutions.alias("institutions"), organizations.alias("organizations"))


def _roster(spark, sf):
    n = F.col("s_suppkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    family = F.concat(F.lit("Customer"), F.format_string("%09d", n))
    return table(spark, sf, "supplier").join(nation, "s_nationkey").select(
        n.alias("person"), n.alias("position"), F.concat(F.lit("0000-"), (n * 50).cast("string")).alias("orcid"), F.array(F.concat(F.lit("Ánna "), family)).alias("aliases"),
        F.when(n % 2 == 0, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("affiliation_terms"), (n % 3 == 0).alias("require_affiliation"), (n % 7 != 0).alias("active"),
    )


@query("""WITH c AS (SELECT c_custkey AS id, n_name, lower(replace(c_name, '#', '')) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey AS person, n_name AS term, 'customer' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS family FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0)
SELECT DISTINCT id, person FROM (SELECT id, person FROM c JOIN s ON id % 50 = 0 AND id = person * 50 UNION ALL SELECT id, person FROM c JOIN s ON name = family
WHERE CASE WHEN person % 2 = 0 THEN contains(lower(n_name), lower(term)) ELSE person % 3 <> 0 END)""")
def match_people(spark, sf):
    return people.match_people(_authors(spark, sf), _roster(spark, sf)).select("id", "person")


@query("""WITH c AS (SELECT c_custkey AS id, n_name, lower(replace(c_name, '#', '')) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey AS person, n_name AS term, 'customer' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS family FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0)
SELECT DISTINCT id FROM (SELECT id FROM c JOIN s ON id % 50 = 0 AND id = person * 50 UNION ALL SELECT id FROM c JOIN s ON name = family
WHERE CASE WHEN person % 2 = 0 THEN contains(lower(n_name), lower(term)) ELSE person % 3 <> 0 END)""")
def discover_by_people(spark, sf):
    return people.discover_by_people(_authors(spark, sf), _roster(spark, sf)).select("id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND c_custkey IS NOT NULL THEN c_mktsegment WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS publisher, o_orderkey % 5 = 0 AND c_custkey IS NOT NULL AS filled FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 3 <> 0")
def fill_missing(spark, sf):
    doi = lambda c: F.concat(F.lit("10.1000/"), c.cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, doi(F.col("o_custkey"))).alias("doi"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("publisher"))
    works = table(spark, sf, "customer").select(F.concat(F.lit("https://doi.org/"), doi(F.col("c_custkey"))).alias("doi"), F.col("c_mktsegment").alias("publisher"))
    return history.fill_missing(rows, works, ["publisher"]).select("o_orderkey", "publisher", (F.size("filled_fields") > 0).alias("filled"))


@query("""WITH c AS (SELECT c_custkey AS id, n_name, lower(replace(c_name, '#', '')) AS name, c_mktsegment AS segment, CAST(CAST(DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS DATE) AS VARCHAR) AS day FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey AS person, n_name AS term, 'customer' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS family FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0),
m AS (SELECT DISTINCT id FROM (SELECT id FROM c JOIN s ON id % 50 = 0 AND id = person * 50 UNION ALL SELECT id FROM c JOIN s ON name = family WHERE CASE WHEN person % 2 = 0 THEN contains(lower(n_name), lower(term)) ELSE person % 3 <> 0 END))
SELECT id FROM c WHERE day BETWEEN '2024-01-10' AND '2024-02-10' AND (segment = 'BUILDING' OR id IN (SELECT id FROM m))""")
def discover(spark, sf):
    """By a clause or a watched author, within a window."""
    authors = _authors(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")))
    return people.discover(authors, [["building"]], _roster(spark, sf), "2024-01-10", "2024-02-10", F.col("segment"), "day", "day").select("id")


@query("""SELECT c_custkey AS id, 'new' AS body FROM customer WHERE c_custkey % 50 = 0 AND c_custkey // 50 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) AND c_custkey % 3 <> 0""")
def discover_last_body(spark, sf):
    """Works that come twice: the earlier one has the author, the later one's body counts, which every third lacks."""
    old = _authors(spark, sf).where("id % 50 = 0").select("id", F.transform("authors", lambda a: F.struct(F.lit("X").alias("name"), a["orcid"].alias("orcid"), a["affiliations"].alias("affiliations"))).alias("authors"))
    new = old.withColumn("authors", F.when(F.col("id") % 3 != 0, F.col("authors")).otherwise(F.slice("authors", 1, 0)))
    works = old.withColumn("body", F.lit("old")).withColumn("at", F.lit(1)).unionByName(new.withColumn("body", F.lit("new")).withColumn("at", F.lit(2)))
    return people.discover_by_people(works, _roster(spark, sf), "at").select("id", "body")


def _maps(m: Column) -> Column:
    """A map of texts as one text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("""WITH j AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 <> 0 AS has, c_custkey IS NOT NULL AND o_orderkey % 3 <> 0 AS met, o_orderkey % 5 = 0 AS no_publisher, o_orderkey % 4 = 0 AS no_authors, o_orderkey % 7 = 0 AS no_date, o_orderstatus, c_mktsegment, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
f AS (SELECT *, concat_ws(',', CASE WHEN met AND no_publisher THEN 'publisher' END, CASE WHEN met AND no_authors THEN 'authors' END, CASE WHEN met AND no_date THEN 'published_date' END) AS filled FROM j)
SELECT k AS o_orderkey, CASE WHEN no_publisher THEN CASE WHEN met THEN c_mktsegment END ELSE o_orderstatus END AS publisher, CASE WHEN no_authors THEN CASE WHEN met THEN c_name END ELSE 'Own' END AS author, CASE WHEN no_date THEN CASE WHEN met THEN '2024-05-01' END ELSE '2020-01-01' END AS day,
CASE WHEN met THEN 'pubmed,crossref' ELSE 'pubmed' END AS sources, CASE WHEN met THEN 'crossref=10.1000/' || c || ',' ELSE '' END || 'pubmed=' || k AS ids, concat_ws(',', CASE WHEN met AND no_authors THEN 'authors=crossref' END, CASE WHEN met AND no_date THEN 'published_date=crossref' END, CASE WHEN met AND no_publisher THEN 'publisher=crossref' END, 'title=pubmed') AS fields,
CASE WHEN met AND no_date THEN 'published_date=month' ELSE 'published_date=day' END AS precision, CASE WHEN met THEN 'https://p/' || k || ' https://w/' || c ELSE 'https://p/' || k END AS urls, CASE WHEN met THEN 2 ELSE 1 END::INTEGER AS n_provenance,
CASE WHEN met THEN filled END AS told, CASE WHEN met THEN 'https://api.crossref.org/works/10.1000%2F' || c END AS told_url, CASE WHEN met THEN sha256(CAST(c AS VARCHAR)) END AS told_sha FROM f""")
def fill_missing_told(spark, sf):
    """Several fields filled by DOI, and all that a record says about it."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    doi = lambda x: F.concat(F.lit("10.1000/"), x.cast("string"))
    text_ = F.lit(None).cast("string")
    entry = F.struct(F.lit("pubmed").alias("source"), k.cast("string").alias("source_id"), text_.alias("url"), F.array().cast("array<string>").alias("fields"), text_.alias("raw_sha256"), text_.alias("note"))
    rows = table(spark, sf, "orders").select(
        k, F.when(k % 3 != 0, doi(F.col("o_custkey"))).alias("doi"), F.when(k % 5 != 0, F.col("o_orderstatus")).otherwise(" ").alias("publisher"), F.when(k % 4 != 0, F.array(F.struct(F.lit("Own").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("authors"),
        F.when(k % 7 != 0, F.lit("2020-01-01").cast("date")).alias("published_date"), F.array(F.lit("pubmed")).alias("source_types"), F.create_map(F.lit("pubmed"), k.cast("string")).alias("source_ids"), F.create_map(F.lit("title"), F.lit("pubmed")).alias("field_sources"),
        F.create_map(F.lit("published_date"), F.lit("day")).alias("date_precision"), F.array(F.concat(F.lit("https://p/"), k.cast("string"))).alias("alternate_urls"), F.array(entry).alias("provenance"),
    )
    works = table(spark, sf, "customer").select(
        F.concat(F.lit("https://doi.org/"), doi(c)).alias("doi"), F.col("c_mktsegment").alias("publisher"), F.array(F.struct(F.col("c_name").alias("name"))).alias("authors"), F.lit("2024-05-01").cast("date").alias("published_date"), F.create_map(F.lit("published_date"), F.lit("month"), F.lit("first_date"), F.lit("day")).alias("date_precision"),
        F.concat(F.lit("https://w/"), c.cast("string")).alias("url"), F.sha2(c.cast("string"), 256).alias("raw_sha256"),
    )
    last = F.get(F.col("provenance"), F.lit(1))
    return history.fill_missing(rows, works, ["publisher", "authors", "published_date"], source="crossref").select(
        "o_orderkey", text.empty_to_null(F.trim("publisher")).alias("publisher"), F.get(F.col("authors"), F.lit(0))["name"].alias("author"), F.col("published_date").cast("string").alias("day"), F.array_join("source_types", ",").alias("sources"), _maps(F.col("source_ids")).alias("ids"), _maps(F.col("field_sources")).alias("fields"),
        _maps(F.col("date_precision")).alias("precision"), F.array_join("alternate_urls", " ").alias("urls"), F.size("provenance").alias("n_provenance"), F.array_join(last["fields"], ",").alias("told"), last["url"].alias("told_url"), last["raw_sha256"].alias("told_sha"),
    )


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, value, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 <> 0 AS known, event_id % 4 = 0 AS before FROM events)
SELECT event_id, CASE WHEN known THEN 3 + (a OR b)::INTEGER ELSE 1 END::INTEGER AS version, CASE WHEN known THEN before::INTEGER + (a OR b)::INTEGER ELSE 0 END::INTEGER AS n_events, CASE WHEN known AND (a OR b) THEN concat_ws(',', CASE WHEN a THEN 'event_type' END, CASE WHEN b THEN 'value' END) END AS fields,
CASE WHEN known AND (a OR b) THEN concat_ws(',', CASE WHEN a THEN 'event_type={"value":"old"}' END, CASE WHEN b THEN 'value={}' END) END AS old_values, CASE WHEN known AND (a OR b) AND NOT b THEN 'event_type={"value":"' || event_type || '"}' END AS new_type, CASE WHEN known AND (a OR b) THEN strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN known THEN 'old,new' ELSE 'new' END AS provenance FROM e""")
def trial_events(spark, sf):
    """Events as trials: what differs from the stored row becomes an event with both values."""
    n = F.col("event_id")
    made = lambda name: F.array(F.struct(F.lit(name).alias("source")))
    now = table(spark, sf, "events").select("event_id", "event_type", "value", F.lit(1).alias("version"), F.col("ts").cast("timestamp").alias("retrieved_at"), made("new").alias("provenance"))
    earlier = F.from_json(F.when(n % 4 == 0, '[{"source":"x"}]').otherwise("[]"), f"array<{history.EVENT}>")
    stored = now.where(n % 5 != 0).select("event_id", F.when(n % 2 == 0, "old").otherwise(F.col("event_type")).alias("event_type"), F.when(n % 3 != 0, F.col("value")).alias("value"), F.lit(3).alias("version"), made("old").alias("provenance"), earlier.alias("change_history"))
    out = history.with_events(stored, now, "event_id", ["event_type", "value"], "trials")
    last = F.get(F.filter("change_history", lambda e: e["source"] == "trials"), F.lit(0))
    return out.select("event_id", "version", F.size("change_history").alias("n_events"), F.array_join(last["fields"], ",").alias("fields"), _maps(last["old_values"]).alias("old_values"), F.when(F.size(last["fields"]) == 1, F.when(last["fields"][0] == "event_type", _maps(last["new_values"]))).alias("new_type"), F.date_format(last["changed_at"], "yyyy-MM-dd").alias("day"), F.array_join(F.col("provenance")["source"], ",").alias("provenance"))


@query("""WITH c AS (SELECT conv_id, turn, 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text, role FROM conversations)
SELECT conv_id, count(*)::INTEGER AS version, strftime(DATE '2024-01-01' + CAST(min(turn) AS INTEGER), '%Y-%m-%d') AS first_date, sha256(arg_max(text, turn)) AS body, string_agg(role || turn, ',' ORDER BY turn) AS provenance, coalesce(string_agg('https://s/' || turn, ' ' ORDER BY turn) FILTER (turn < (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id)), '') AS urls,
coalesce(string_agg(before || '>' || turn, ',' ORDER BY turn) FILTER (before IS NOT NULL), '') AS events FROM c GROUP BY conv_id""")
def coalesce_preprints(spark, sf):
    """Turns of a conversation as versions of a preprint."""
    n = F.col("turn")
    rows = table(spark, sf, "conversations").select(
        "conv_id", F.lit(None).cast("string").alias("doi"), F.col("conv_id").cast("string").alias("id"), F.struct(n.alias("version"), F.lit("s").alias("server")).alias("preprint"), F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).alias("first_date"), F.col("text").alias("abstract"),
        F.lit("2024-03-01").cast("timestamp").alias("retrieved_at"), F.array(F.struct(F.concat("role", n.cast("string")).alias("source"))).alias("provenance"), F.concat(F.lit("https://s/"), n.cast("string")).alias("url"), F.array().cast("array<string>").alias("alternate_urls"),
    )
    number = lambda m: F.get_json_object(F.element_at(m, "version"), "$.value")
    events = F.transform("change_history", lambda e: F.concat(number(e["old_values"]), F.lit(">"), number(e["new_values"])))
    return history.coalesce_preprints(rows).select("conv_id", "version", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.sha2("abstract", 256).alias("body"), F.array_join(F.col("provenance")["source"], ",").alias("provenance"), F.array_join("alternate_urls", " ").alias("urls"), F.array_join(events, ",").alias("events"))


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def changed_records(spark, sf):
    today = table(spark, sf, "documents").select("doc_id", "text", "lang")
    before = today.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return history.changed_records(before, today, "doc_id").select("doc_id")


@query("SELECT event_id, CASE WHEN event_type IS NOT DISTINCT FROM prev_type AND value IS NOT DISTINCT FROM prev_value THEN '' ELSE array_to_string(list_filter([CASE WHEN event_type IS DISTINCT FROM prev_type THEN 'trial.event_type' END, CASE WHEN value IS DISTINCT FROM prev_value THEN 'trial.value' END], lambda x: x IS NOT NULL), ',') END AS fields, CASE WHEN event_type IS NOT DISTINCT FROM prev_type AND value IS NOT DISTINCT FROM prev_value THEN 1 ELSE 2 END AS version FROM (SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE event_type END AS prev_type, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS prev_value FROM events)")
def apply_trial_updates(spark, sf):
    now = table(spark, sf, "events").select("event_id", "event_type", "value", F.lit(1).alias("version"))
    before = now.withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "click").otherwise(F.col("event_type"))).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return history.apply_trial_updates(before, now, "event_id", ["event_type", "value"]).select("event_id", F.array_join("changed_fields", ",").alias("fields"), "version")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def pending_enrichment(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    cache = df.where("doc_id % 3 = 0").select(history.enrichment_input_hash(["doc_id", "text"], "m", "1").alias("input_hash"))
    return history.pending_enrichment(df, cache, ["doc_id", "text"], "m", "1").select("doc_id")


@query(f"WITH {R} SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 AND NOT list_contains(modalities, 'ASO') THEN list_append(modalities, 'ASO') ELSE modalities END, ',') AS modalities, CASE WHEN doc_id % 2 = 0 THEN 'rules+llm' ELSE 'rules' END AS method FROM r")
def apply_enrichment(spark, sf):
    df = records(spark, sf).withColumn("input_hash", F.sha2("abstract", 256)).withColumn("classification_method", F.lit("rules"))
    results = df.select("id", "input_hash", F.when(F.col("doc_id") % 2 == 0, "model").otherwise("none").alias("provider"), F.array(F.lit("ASO"), F.lit("made up")).alias("modalities"))
    out = history.apply_enrichment(df, results, ["modalities"], report.VOCABULARIES, [])
    return out.select("doc_id", F.array_join("modalities", ",").alias("modalities"), F.col("classification_method").alias("method"))


def _evidence(c: Column) -> Column:
    """Evidence as one text: category, then label, confidence, fields and method of each entry."""
    entry = lambda e: F.concat_ws("|", e["label"], e["confidence"].cast("string"), F.array_join(e["matched_phrases"], "+"), F.array_join(e["fields"], "+"), e["method"])
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda m: F.concat(m["key"], F.lit(":"), F.array_join(F.transform(m["value"], entry), ";"))), " / ")


@query(f"""WITH {{R}}, m AS (SELECT doc_id, modalities, doc_id % 2 = 0 AS met, list_distinct(['ASO', 'mRNA']) AS given FROM r)
SELECT doc_id, CASE WHEN met THEN array_to_string(list_concat(CASE WHEN list_contains(modalities, 'mRNA') THEN ['mRNA|1.0|license|abstract|deterministic-rules'] ELSE []::VARCHAR[] END, ['ASO|0.6||llm_enrichment|llm:model'], CASE WHEN list_contains(modalities, 'mRNA') THEN []::VARCHAR[] ELSE ['mRNA|0.6||llm_enrichment|llm:model'] END), ';')
  WHEN list_contains(modalities, 'mRNA') THEN 'mRNA|1.0|license|abstract|deterministic-rules' ELSE '' END AS evidence, CASE WHEN met THEN 'said' ELSE 'own' END AS summary, CASE WHEN met THEN NULL ELSE 'doubt' END AS doubt, CASE WHEN met THEN 'model v1' END AS metadata FROM m""".replace("{R}", R))
def apply_enrichment_told(spark, sf):
    """Evidence for labels that have none, texts taken or replaced, and what the result says about itself."""
    none = F.array().cast("array<string>")
    rule = F.struct(F.lit("mRNA").alias("label"), F.lit(1.0).alias("confidence"), F.array(F.lit("license")).alias("matched_phrases"), F.array(F.lit("abstract")).alias("fields"), F.lit("deterministic-rules").alias("method"))
    evidence = F.when(F.array_contains("modalities", "mRNA"), F.create_map(F.lit("modalities"), F.array(rule).cast(classify.EVIDENCE))).otherwise(F.create_map().cast(f"map<string,{classify.EVIDENCE}>"))
    df = records(spark, sf).withColumn("input_hash", F.sha2("abstract", 256)).withColumn("classification_evidence", evidence).withColumn("summary", F.lit("own")).withColumn("uncertainty_notes", F.lit("doubt")).withColumn("enrichment_metadata", F.lit(None).cast("struct<provider:string,model:string,input_hash:string>"))
    results = df.select("id", "input_hash", F.when(F.col("doc_id") % 2 == 0, "model").otherwise("none").alias("provider"), F.lit("v1").alias("model"), F.array(F.lit("ASO"), F.lit("mRNA"), F.lit("made up")).alias("modalities"), F.lit("said").alias("summary"), F.lit(None).cast("string").alias("uncertainty_notes"), none.alias("species"))
    out = history.apply_enrichment(df, results, ["modalities"], report.VOCABULARIES, ["summary"], ["uncertainty_notes"])
    told = F.when(F.col("enrichment_metadata").isNotNull(), F.concat_ws(" ", "enrichment_metadata.provider", "enrichment_metadata.model"))
    return out.select("doc_id", F.regexp_replace(_evidence(F.col("classification_evidence")), "^modalities:", "").alias("evidence"), "summary", F.col("uncertainty_notes").alias("doubt"), told.alias("metadata"))


# --- duplicates -------------------------------------------------------------------------------------------------------------


def _title_keys(df):
    return {"text": F.sha2(text.normalize_title(F.col("abstract"), unicode_forms=False), 256), "title": F.when(F.length("title") > 40, F.sha2("title", 256))}


_KEYS = "k AS (SELECT doc_id, id, 'text' AS kind, trim(regexp_replace(regexp_replace(lower(abstract), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM r UNION ALL SELECT doc_id, id, 'title', title FROM r WHERE length(title) > 40)"
_COMPONENTS = f"WITH RECURSIVE {R}, {_KEYS}, m AS (SELECT id, min(id) OVER (PARTITION BY kind, v) AS hub FROM k), e AS (SELECT id AS a, hub AS b FROM m WHERE id <> hub UNION SELECT hub, id FROM m WHERE id <> hub), c AS (SELECT a, a AS b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"


@query(f"WITH {R}, {_KEYS}, h AS (SELECT *, min(id) OVER (PARTITION BY kind, v) AS hub FROM k) SELECT DISTINCT hub AS left_id, id AS right_id, 'same ' || kind AS reason, 1.0::DOUBLE AS confidence FROM h WHERE id <> hub")
def exact_edges(spark, sf):
    df = records(spark, sf)
    return dedup.exact_edges(df, _title_keys(df))


@query("SELECT CAST(doc_id AS VARCHAR) AS left_id, CAST(doc_id + 1 AS VARCHAR) AS right_id FROM documents WHERE doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)")
def preprint_edges(spark, sf):
    doi = lambda n: F.concat(F.lit("doi: 10.1000/"), n.cast("string"))
    n = F.col("doc_id")
    return dedup.preprint_edges(records(spark, sf), F.when(n % 2 == 1, doi(n - 1)), F.when(n % 2 == 0, doi(n))).select("left_id", "right_id")


@query("""WITH j AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id // 7 AS d FROM documents WHERE doc_id % 7 IN (0, 3, 5)), p AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id // 7 AS d FROM documents WHERE doc_id % 7 IN (1, 3, 4)),
h AS (SELECT d, min(j.id) AS first, (SELECT min(p.id) FROM p WHERE p.d = j.d) AS preprint FROM j GROUP BY d HAVING (SELECT min(p.id) FROM p WHERE p.d = j.d) IS NOT NULL)
SELECT DISTINCT * FROM (SELECT first AS left_id, p.id AS right_id FROM p JOIN h USING (d) UNION ALL SELECT j.id, preprint FROM j JOIN h USING (d) WHERE j.id <> first) WHERE left_id <> right_id""")
def preprint_stars(spark, sf):
    """Several journal records and preprints of one DOI, one of them both."""
    n, kind = F.col("doc_id"), F.col("doc_id") % 7
    doi = F.concat(F.lit("doi: 10.1000/"), F.floor(n / 7).cast("string"))
    return dedup.preprint_edges(records(spark, sf), F.when(kind.isin(1, 3, 4), doi), F.when(kind.isin(0, 3, 5), doi)).select("left_id", "right_id")


def _chained(spark, sf):
    """Edges between documents three and five apart, in blocks of forty."""
    n = F.col("doc_id")
    other = F.explode(F.filter(F.array(n + 3, n + 5), lambda m: F.floor(m / 40) == F.floor(n / 40)))
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    made = table(spark, sf, "documents").select(name(n).alias("left_id"), other.alias("m")).select("left_id", name(F.col("m")).alias("right_id"))
    known = table(spark, sf, "documents").select(name(n).alias("right_id"))
    return made.join(known, "right_id", "left_semi")


@query("""WITH RECURSIVE d AS (SELECT doc_id AS n FROM documents), k AS (SELECT b * 40 AS n, 0 AS i, b, [true] AS kept FROM (SELECT DISTINCT n // 40 AS b FROM d)
UNION ALL SELECT b * 40 + i + 1, i + 1, b, list_append(kept, NOT (coalesce(i >= 2 AND kept[i - 1], false) OR coalesce(i >= 4 AND kept[i - 3], false))) FROM k WHERE i < 39),
f AS (SELECT b, kept FROM k WHERE i = 39), s AS (SELECT n, n % 40 AS i, kept FROM d JOIN f ON f.b = n // 40)
SELECT lpad(CAST(n AS VARCHAR), 12, '0') AS id, lpad(CAST(CASE WHEN kept[i + 1] THEN n WHEN i >= 5 AND kept[i - 4] THEN n - 5 ELSE n - 3 END AS VARCHAR), 12, '0') AS cluster FROM s
WHERE (i >= 3 AND n - 3 IN (SELECT n FROM d)) OR (i >= 5 AND n - 5 IN (SELECT n FROM d)) OR (i + 3 < 40 AND n + 3 IN (SELECT n FROM d)) OR (i + 5 < 40 AND n + 5 IN (SELECT n FROM d))""")
def cluster_greedy(spark, sf):
    return dedup.cluster_greedy(_chained(spark, sf))


@query(f"{_COMPONENTS} SELECT a AS id, min(b) AS cluster FROM c GROUP BY 1")
def cluster(spark, sf):
    df = records(spark, sf)
    return dedup.cluster(dedup.exact_edges(df, _title_keys(df)))


def _deduplicated(spark, sf):
    df = records(spark, sf)
    return dedup.deduplicate(df, dedup.exact_edges(df, _title_keys(df)), ["title"], ["modalities"], last=["relevance_score"])


@query(f"{_COMPONENTS}, g AS (SELECT id, coalesce(cl, id) AS cluster, source, score, excluded FROM r LEFT JOIN (SELECT a, min(b) AS cl FROM c GROUP BY 1) ON a = id) SELECT cluster, max(id) AS id, count(*)::INTEGER AS n_members, max(score) AS score, bool_and(excluded) AS excluded, count(DISTINCT source)::INTEGER AS n_sources FROM g GROUP BY 1")
def merge_cluster(spark, sf):
    return _deduplicated(spark, sf)[0].select("cluster", "id", "n_members", F.col("relevance_score").alias("score"), "excluded", F.size("source_types").alias("n_sources"))


@query(f"{_COMPONENTS} SELECT min(b) AS kept_id, a AS merged_id, 1.0::DOUBLE AS confidence FROM c GROUP BY a HAVING min(b) <> a")
def merge_decisions(spark, sf):
    return _deduplicated(spark, sf)[1].select("kept_id", "merged_id", "confidence")


@query()
def title_edges(spark, sf):
    named = F.array(F.struct(F.concat(F.lit("Anna "), "source").alias("name"), F.lit("Anna").alias("given_name"), F.col("lang").alias("family_name"), F.lit(None).cast("string").alias("orcid")))
    return dedup.title_edges(records(spark, sf).select("id", "title", named.alias("authors"), F.year("updated_date").alias("year")))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def preferred_member(spark, sf):
    return dedup.preferred_member(table(spark, sf, "documents"), "source", [F.col("n_chars").desc(), F.col("doc_id")]).select("source", "doc_id")


# --- revisions ----------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_revision(spark, sf):
    return history.latest_revision(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT * FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_turn FROM conversations) WHERE previous_turn IS NOT NULL")
def revision_events(spark, sf):
    return history.revision_events(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "previous_turn")


@query("SELECT conv_id, count(*)::INTEGER AS version, min(turn) AS first_turn, arg_max(text, turn) AS text, (count(*) - 1)::INTEGER AS n_events FROM conversations GROUP BY 1")
def coalesce_revisions(spark, sf):
    df = table(spark, sf, "conversations").withColumn("first_turn", F.col("turn"))
    return history.coalesce_revisions(df, "conv_id", "turn", "first_turn", ["text"]).select("conv_id", "version", "first_turn", "text", F.size("change_history").alias("n_events"))


@query("SELECT event_id, strftime(min(ts) OVER (PARTITION BY user_id), '%Y-%m-%d') AS first FROM events")
def carry_first_date(spark, sf):
    return history.carry_first_date(table(spark, sf, "events"), "user_id", "ts").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("first"))


@query("""WITH p AS (SELECT *, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, n > 1 AND (event_type IS DISTINCT FROM pt OR value IS DISTINCT FROM pv) AS c FROM p)
SELECT event_id, (1 + sum(c::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS version, CASE WHEN n = 1 THEN 0 ELSE (event_type IS DISTINCT FROM pt)::INTEGER + (value IS DISTINCT FROM pv)::INTEGER END AS n_changed FROM q""")
def snapshot_history(spark, sf):
    return history.snapshot_history(table(spark, sf, "events"), "user_id", "ts", ["event_type", "value"], "event_id").select("event_id", "version", F.size("changed_fields").alias("n_changed"))


@query("SELECT event_type AS source, strftime(max(ts) - INTERVAL 7 DAY, '%Y-%m-%d') AS since, '2024-02-10' AS until FROM events GROUP BY 1")
def plan_windows(spark, sf):
    state = table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").cast("date").alias("last_successful_until"))
    return history.plan_windows(state, "2024-02-10", {r["source"]: (7, 30) for r in state.select("source").collect()}).select("source", F.col("since").cast("string").alias("since"), F.col("until").cast("string").alias("until"))


@query("SELECT event_type AS source, strftime(CASE WHEN event_type < 'e' THEN max(ts) ELSE min(ts) END, '%Y-%m-%d') AS last, CASE WHEN event_type < 'e' THEN count(*) ELSE 0 END AS n FROM events GROUP BY 1")
def advance_state(spark, sf):
    by = table(spark, sf, "events").groupBy(F.col("event_type").alias("source"))
    state = by.agg(F.min("ts").cast("date").alias("last_successful_until"), F.min("ts").alias("last_retrieved_at"), F.lit(0).cast("long").alias("raw_count"))
    results = by.agg(F.max("ts").cast("date").alias("until"), F.max("ts").alias("retrieved_at"), F.count("*").alias("raw_count")).withColumn("ok", F.col("source") < "e")
    return history.advance_state(state, results).select("source", F.date_format("last_successful_until", "yyyy-MM-dd").alias("last"), F.col("raw_count").alias("n"))


def _incoming(spark, sf):
    """Records in twos of one DOI, with what the update job reads."""
    none = F.lit(None).cast("string")
    author = F.struct(F.col("source").alias("name"), none.alias("orcid"), F.array("lang").alias("affiliations"))
    made = records(spark, sf).withColumn("doi", F.concat(F.lit("https://doi.org/10.1/"), F.floor(F.col("doc_id") / 2).cast("string"))).withColumn("authors", F.array(author))
    return made.withColumn("keywords", F.array(F.concat(F.lit("k"), "id"), "lang")).drop("relevance_score", "doc_id")


def _updated(spark, existing, incoming, sf, days, as_of=AS_OF):
    works = table(spark, sf, "nation").select(F.lit("10.9/none").alias("doi"))
    return jobs.update(existing, incoming, _roster(spark, sf), works, RULES, as_of, days, updated())


def _told(kept):
    return kept.select("cluster", "id", F.col("n_members").cast("long").alias("n_rows"), "title", F.sha2("abstract", 256).alias("abstract_sha"), F.array_join("source_types", ",").alias("sources"), F.array_join("keywords", ",").alias("keywords"), "excluded", F.col("updated_date").cast("string").alias("day"))


def _merged_sql(rows: str, having: str) -> str:
    """Records of `rows` (id, doi, title, abstract, source, lang, excluded, day), merged by DOI."""
    union = lambda values: f"(SELECT string_agg(v, ',' ORDER BY id, pos) FROM (SELECT DISTINCT ON (v) v, id, pos FROM (SELECT id, unnest({values}) AS v, generate_subscripts({values}, 1) AS pos FROM {rows} m WHERE m.doi = g.doi) ORDER BY v, id, pos))"
    return f"""SELECT min(id || ' @' || source) AS cluster, CASE WHEN count(*) > 1 THEN 'doi:' || g.doi ELSE min(id) END AS id, count(*) AS n_rows, arg_max(title, id) FILTER (title <> '') AS title,
sha256(arg_max(abstract, id) FILTER (abstract <> '')) AS abstract_sha, {union("[source]")} AS sources, {union("['k' || id, lang]")} AS keywords, bool_and(excluded) AS excluded, max(day) AS day FROM {rows} g GROUP BY g.doi {having}"""


@query(f"WITH {R}, b AS (SELECT *, '10.1/' || doc_id // 2 AS doi FROM r) {_merged_sql('b', f"HAVING max(day) BETWEEN '2024-02-09' AND '{AS_OF}'")}")
def update_job(spark, sf):
    return _told(_updated(spark, None, _incoming(spark, sf), sf, 7).records)


@query(f"""WITH {R}, b AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 3 THEN 'new ' || title ELSE title END AS title, CASE WHEN doc_id % 10 = 6 THEN 'more ' || abstract ELSE abstract END AS abstract),
'10.1/' || CASE WHEN doc_id % 10 = 5 THEN (doc_id + 2) // 2 ELSE doc_id // 2 END AS doi FROM r) {_merged_sql('b', '')}""")
def update_job_second_run(spark, sf):
    """After a first run some rows come alone with another title, text or DOI; a third run brings all of them again, unchanged."""
    first = _incoming(spark, sf)
    n = F.col("id").cast("long")
    second = first.where(n % 10 != 1).withColumn("title", F.when(n % 10 == 3, F.concat(F.lit("new "), "title")).otherwise(F.col("title"))).withColumn("abstract", F.when(n % 10 == 6, F.concat(F.lit("more "), "abstract")).otherwise(F.col("abstract")))
    second = second.withColumn("doi", F.when(n % 10 == 5, F.concat(F.lit("10.1/"), F.floor((n + 2) / 2).cast("string"))).otherwise(F.col("doi"))).where((n % 10).isin(2, 3, 5, 6))
    corpus = _updated(spark, None, first, sf, 90, LATER).corpus
    corpus = _updated(spark, corpus, second, sf, 90, LATER).corpus
    return _told(_updated(spark, corpus, second, sf, 90, LATER).records)


# --- classification, scores, reports ----------------------------------------------------------------------------------------


def _hits(pattern: str, column: str) -> str:
    return f"len(regexp_extract_all(lower({column}), '{pattern}'))"


_A = r"\blicen[sc]ed?\b"
_B, _C, _D = r"\btoken\b", r"\b(?:idiot|moron|clown)\b", r"\bthe\b"


@query(f"""WITH {R}, s AS (SELECT doc_id, 3 * ({_hits(_A, 'title')} + {_hits(_B, 'title')}) + {_hits(_A, 'abstract')} + {_hits(_B, 'abstract')} AS a, 2 * (3 * {_hits(_C, 'title')} + {_hits(_C, 'abstract')}) AS b,
regexp_matches(lower(abstract), '\\bapache\\b') AS stop, 3 * {_hits(_D, 'title')} + {_hits(_D, 'abstract')} AS c FROM r)
SELECT doc_id, array_to_string(list_filter([CASE WHEN a >= 1 THEN 'terms' END, CASE WHEN b >= 2 AND NOT stop THEN 'insult' END], lambda x: x IS NOT NULL), ',') AS topics, CASE WHEN c >= 20 THEN 'common' ELSE '' END AS methods FROM s""")
def classify_records(spark, sf):
    return classify.classify(records(spark, sf), RULES, WEIGHTS).select("doc_id", F.array_join("topics", ",").alias("topics"), F.array_join("methods", ",").alias("methods"))


@query(f"WITH {R} SELECT doc_id, excluded OR (len(modalities) = 0 AND regexp_matches(lower(abstract), '{_C}')) AS excluded FROM r")
def apply_global_negatives(spark, sf):
    df = records(spark, sf).withColumn("exclusion_reasons", F.array().cast("array<string>"))
    return classify.apply_global_negatives(df, [_C], WEIGHTS).select("doc_id", "excluded")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source || CASE WHEN doc_id % 2 = 0 THEN ' University' ELSE ' Pharma Inc' END ELSE '' END AS companies, CASE WHEN doc_id % 3 = 0 THEN source || CASE WHEN doc_id % 2 = 0 THEN ' University' ELSE ' Pharma Inc' END ELSE '' END AS institutions FROM documents")
def metadata_labels(spark, sf):
    return classify.metadata_labels(_organized(spark, sf)).select("doc_id", F.array_join("companies", ",").alias("companies"), F.array_join("institutions", ",").alias("institutions"))


_ORG = "source || CASE WHEN doc_id % 2 = 0 THEN ' University' ELSE ' Pharma Inc' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'companies:' ELSE 'institutions:' END || {_ORG} || '|1.0|' || {_ORG} || '|organizations|source-metadata' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '' END || ' / topics:x|0.5|||rules' AS evidence FROM documents")
def metadata_evidence(spark, sf):
    none = F.array().cast("array<string>")
    rule = F.struct(F.lit("x").alias("label"), F.lit(0.5).alias("confidence"), none.alias("matched_phrases"), none.alias("fields"), F.lit("rules").alias("method"))
    df = _organized(spark, sf).withColumn("classification_evidence", F.create_map(F.lit("topics"), F.array(rule).cast(classify.EVIDENCE)))
    return classify.metadata_labels(df).select("doc_id", _evidence(F.col("classification_evidence")).alias("evidence"))


@query(f"""WITH {R}, d AS (SELECT *, datediff('day', CAST(day AS DATE), DATE '{AS_OF}') AS age, len(modalities) AS m, regexp_matches(lower(abstract), '\\b(?:therapeutic|therapy|treatment|drug|vaccine|clinical trial|approved)\\b') AS anchored FROM r),
c AS (SELECT doc_id, excluded, CASE WHEN m = 0 THEN 0.0 WHEN anchored THEN 25.0 ELSE 15.0 END AS direct, CASE m WHEN 0 THEN 0.0 WHEN 1 THEN 8.0 ELSE 10.0 END AS specific, CASE WHEN record_type = 'clinical_trial' THEN 10.0 ELSE 0.0 END AS human, CASE WHEN age < 0 THEN 0.0 WHEN age <= 7 THEN 5.0 WHEN age <= 30 THEN 4.0 WHEN age <= 90 THEN 2.0 ELSE 1.0 END AS recent, age, m, anchored FROM d)
SELECT doc_id, 'direct therapeutic relevance=' || direct || ', RNA modality specificity=' || specific || ', delivery relevance=0.0, translational stage=0.0, human relevance=' || human || ', clinical status change=0.0, regulatory importance=0.0, methodological relevance=0.0, recency=' || recent || ', source corroboration=0.0'
|| CASE WHEN excluded THEN ', exclusion adjustment=' || CASE WHEN direct + specific + human + recent > 15 THEN 15.0 - (direct + specific + human + recent) ELSE 0.0 END ELSE '' END AS components, CASE WHEN age < 0 THEN 'days=none' ELSE 'days=' || age END AS why, 'modalities=' || m || ' deliveries=0 context=' || anchored AS direct_why FROM c""")
def score_components(spark, sf):
    out = classify.score(records(spark, sf).drop("relevance_score", "topics"), AS_OF, updated())
    of = lambda name: F.get(F.filter("score_components", lambda c: c["name"] == name), F.lit(0))["reason"]
    said = F.array_join(F.transform("score_components", lambda c: F.concat(c["name"], F.lit("="), c["points"].cast("string"))), ", ")
    return out.select("doc_id", said.alias("components"), of("recency").alias("why"), of("direct therapeutic relevance").alias("direct_why"))


@query(f"""WITH {R}, p AS (SELECT doc_id, excluded, CASE WHEN len(modalities) > 0 THEN 15.0 ELSE 0.0 END + CASE len(modalities) WHEN 0 THEN 0.0 WHEN 1 THEN 8.0 ELSE 10.0 END + CASE WHEN record_type = 'clinical_trial' THEN 10.0 ELSE 0.0 END
+ CASE WHEN day > '{AS_OF}' THEN 0.0 WHEN datediff('day', CAST(day AS DATE), DATE '{AS_OF}') <= 7 THEN 5.0 WHEN datediff('day', CAST(day AS DATE), DATE '{AS_OF}') <= 30 THEN 4.0 WHEN datediff('day', CAST(day AS DATE), DATE '{AS_OF}') <= 90 THEN 2.0 ELSE 1.0 END AS s FROM r)
SELECT doc_id, CASE WHEN excluded THEN least(s, 15.0) ELSE s END::DOUBLE AS score, CASE WHEN excluded THEN 11 ELSE 10 END AS n_components FROM p""")
def score(spark, sf):
    return classify.score(records(spark, sf).drop("relevance_score", "topics"), AS_OF, updated()).select("doc_id", F.col("relevance_score").alias("score"), F.size("score_components").alias("n_components"))


@query(f"WITH {R} SELECT count(*) AS total, count(*) FILTER (NOT excluded) AS included, count(*) FILTER (excluded) AS excluded, 0::BIGINT AS changed, round_even(avg(score) FILTER (NOT excluded), 2) AS mean_score FROM r")
def statistics(spark, sf):
    return report.statistics(records(spark, sf))


@query(f"WITH {R} SELECT source AS value, count(*) AS n FROM r GROUP BY 1")
def counts_by(spark, sf):
    return report.counts_by(records(spark, sf), "source_types")


@query(f"WITH {R}, e AS (SELECT 'record_type' AS facet, record_type AS value FROM r UNION ALL SELECT 'source_types', source FROM r UNION ALL SELECT 'modalities', unnest(modalities) FROM r UNION ALL SELECT 'lang', lang FROM r) SELECT facet, value, count(*) AS n FROM e GROUP BY ALL")
def facets(spark, sf):
    return report.facets(records(spark, sf), ["record_type", "source_types", "modalities", "lang"])


@query("SELECT DISTINCT event_type AS value FROM events")
def facet_values(spark, sf):
    return report.facet_values(table(spark, sf, "events"), "event_type")


@query("SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS changed, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) AS removed")
def update_report(spark, sf):
    df = table(spark, sf, "documents")
    sources = df.groupBy("source").agg(F.count("*").alias("raw_count"), F.count("lang").alias("normalized_count"))
    return report.update_report(df, df.where("doc_id % 2 = 0"), df.where("doc_id % 9 = 0"), sources).select("total", "changed", "removed")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, '{\"id\":\"' || doc_id || '\"' || CASE WHEN doc_id % 2 = 0 THEN ',\"lang\":\"' || lang || '\"' ELSE '' END || ',\"provenance\":[{\"source\":\"' || source || '\"}]}' AS json FROM documents")
def public_projection(spark, sf):
    df = records(spark, sf).select("id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.array(F.struct("source", F.sha2("abstract", 256).alias("raw_sha256"))).alias("provenance"))
    return report.public_projection(df)


@query(f"WITH {R} SELECT id, 'lang' AS field, lang AS bad FROM r WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT id, 'relevance_score', CAST(score AS VARCHAR) FROM r WHERE score > 90 UNION ALL SELECT min(id), 'title', title FROM r GROUP BY title HAVING count(*) > 1")
def validate_records(spark, sf):
    out = report.validate_records(records(spark, sf), report.VOCABULARIES | {"lang": ["en", "fr"]}, {"relevance_score": (0, 90)}, unique=["title"])
    return out.select("id", "field", F.array_join("bad_values", ",").alias("bad"))


_QUERIES |= streams.QUERIES | landed.QUERIES | views.QUERIES
_SQL |= streams.SQL | landed.SQL | views.SQL


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
