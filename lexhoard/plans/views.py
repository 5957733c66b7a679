"""Queries of views, flat files and whole jobs over a record view with every field that they read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.functions import dates
from lexhoard.operators import report, select
from lexhoard.plans import jobs
from lexhoard.session import shared_dir, table

AS_OF = "2024-02-15"


def _picked(of: dict[int, str], n: int) -> Column:
    """An array of the labels whose number divides doc_id, or has a remainder of 1 by n."""
    return F.filter(F.array(*[F.when(F.col("doc_id") % n == k, F.lit(x)) for k, x in of.items()]), lambda x: x.isNotNull())


def _picked_sql(of: dict[int, str], n: int) -> str:
    return "CASE doc_id % " + str(n) + " " + " ".join(f"WHEN {k} THEN ['{x}']" for k, x in of.items()) + " ELSE []::VARCHAR[] END"


_MODALITIES = {0: "mRNA", 1: "siRNA", 2: "ASO", 3: "CRISPR RNA", 4: "aptamer", 5: "RNA nanostructure"}
_TOPICS = {0: "CRISPR", 1: "base editing", 2: "gene editing", 3: "delivery", 4: "regulation"}
_STAGES = {0: "Phase 1", 1: "preclinical animal", 2: "approved"}
_DELIVERY = {0: "LNP", 4: "AAV"}


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("doc_id"), F.array().cast("array<string>")
    kind = F.when(n % 3 == 0, "affiliation").otherwise("sponsor")
    name = F.when(n % 4 == 0, F.concat("source", F.lit(" University"))).when(n % 4 == 1, F.concat("source", F.lit(" Pharma Inc"))).otherwise(F.col("source"))
    day = lambda k: F.when(n % k != 0, F.date_add(F.lit("2024-01-01").cast("date"), ((n * k) % 60).cast("int")))
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("id"), n, F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"), F.coalesce("text", F.lit("")).alias("abstract"), F.array("source").alias("source_types"), "source",
        F.when(n % 5 == 0, "clinical_trial").when(n % 5 == 1, "regulatory").otherwise("publication").alias("record_type"), F.when(n % 8 == 0, "regulatory document").otherwise("preprint").alias("evidence_level"),
        _picked(_MODALITIES, 7).alias("modalities"), _picked(_TOPICS, 6).alias("topics"), _picked(_STAGES, 4).alias("development_stages"), _picked(_DELIVERY, 9).alias("delivery_systems"), none.alias("disease_areas"),
        F.when(n % 10 == 0, F.array(F.lit("Acme"))).otherwise(none).alias("companies"), F.when(n % 11 == 0, F.array(F.lit("Uni"))).otherwise(none).alias("institutions"), F.array(F.struct(name.alias("name"), kind.alias("organization_type"))).alias("organizations"),
        F.when(n % 3 == 0, F.array(F.struct(F.array(F.lit("trial.phase")).alias("fields")))).otherwise(F.array().cast("array<struct<fields:array<string>>>")).alias("change_history"), F.when(n % 13 == 0, F.array(F.lit("ada"), F.lit("bo"))).otherwise(none).alias("watched_people"),
        (n % 13 == 0).alias("excluded"), (n * 37 % 101).cast("double").alias("relevance_score"), F.concat(F.lit("https://e.org/"), n.cast("string")).alias("url"), F.when(n % 2 == 0, F.concat(F.lit("10.1/"), n.cast("string"))).alias("doi"),
        day(2).alias("first_date"), day(3).alias("published_date"), day(5).alias("updated_date"), day(7).alias("electronic_published_date"), F.lit("2024-03-01").cast("timestamp").alias("retrieved_at"),
    )


def _day_sql(k: int) -> str:
    return f"CASE WHEN doc_id % {k} <> 0 THEN CAST(DATE '2024-01-01' + CAST((doc_id * {k}) % 60 AS INTEGER) AS DATE) END"


_R = f"""r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS abstract, source, CASE WHEN doc_id % 5 = 0 THEN 'clinical_trial' WHEN doc_id % 5 = 1 THEN 'regulatory' ELSE 'publication' END AS record_type,
CASE WHEN doc_id % 8 = 0 THEN 'regulatory document' ELSE 'preprint' END AS evidence_level, {_picked_sql(_MODALITIES, 7)} AS modalities, {_picked_sql(_TOPICS, 6)} AS topics, {_picked_sql(_STAGES, 4)} AS stages, {_picked_sql(_DELIVERY, 9)} AS delivery,
doc_id % 10 = 0 AS company, doc_id % 11 = 0 AS institution, doc_id % 3 = 0 AS changed, doc_id % 13 = 0 AS watched, doc_id % 13 = 0 AS excluded, CAST(doc_id * 37 % 101 AS DOUBLE) AS score, {_day_sql(2)} AS first_date, {_day_sql(3)} AS published_date, {_day_sql(5)} AS updated_date, {_day_sql(7)} AS electronic FROM documents),
d AS (SELECT *, coalesce(updated_date, published_date, first_date) AS display, coalesce(first_date, published_date, updated_date) AS dedup, CASE WHEN record_type = 'clinical_trial' THEN coalesce(updated_date, published_date, first_date) ELSE coalesce(electronic, published_date, first_date, updated_date) END AS retention FROM r)"""

_VIEWS = {
    "mrna": "list_contains(modalities, 'mRNA')", "sirna": "list_contains(modalities, 'siRNA')", "aso": "list_contains(modalities, 'ASO')", "crispr": "list_contains(modalities, 'CRISPR RNA') OR list_contains(topics, 'CRISPR')", "base-editing": "list_contains(topics, 'base editing')",
    "industry": "company OR doc_id % 4 = 1", "academic": "institution OR (doc_id % 3 = 0 AND doc_id % 4 = 0)", "clinical": "record_type = 'clinical_trial' OR list_contains(stages, 'Phase 1')", "preclinical": "list_contains(stages, 'preclinical animal')", "delivery": "len(delivery) > 0 OR list_contains(topics, 'delivery')",
    "regulatory": "record_type = 'regulatory' OR evidence_level = 'regulatory document' OR list_contains(topics, 'regulation')", "aptamers": "list_contains(modalities, 'aptamer')", "nanotechnology": "list_contains(modalities, 'RNA nanostructure')", "trial-changes": "record_type = 'clinical_trial' AND changed", "watched-authors": "watched",
    "technology mRNA": "list_contains(modalities, 'mRNA')", "technology siRNA": "list_contains(modalities, 'siRNA')", "technology ASO": "list_contains(modalities, 'ASO')", "technology CRISPR": "list_contains(modalities, 'CRISPR RNA') OR list_contains(topics, 'CRISPR')", "technology base editing": "list_contains(topics, 'base editing')", "technology gene editing": "len(list_intersect(topics, ['gene editing', 'base editing', 'CRISPR'])) > 0",
}


def all_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named view and technology of every record."""
    return select.matched_views(full_records(spark, sf_dir)).select("doc_id", F.explode("views").alias("view"))


def flat_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as a quoted CSV file, read back."""
    at = f"{shared_dir(spark)}/lexhoard-flat-{uuid.uuid4().hex}"
    select.write_flat_csv(full_records(spark, sf_dir), at)
    return select.read_flat_csv(spark, at)


def record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dates of each record, and whether it is kept by each window."""
    df = full_records(spark, sf_dir)
    kept = select.retain_recent(df, AS_OF, 30).select("doc_id", F.lit(True).alias("recent"))
    shown = select.last_days(df.withColumn("d", dates.display_date()), AS_OF, 7, "d").select("doc_id", F.lit(True).alias("last_week"))
    out = df.select("doc_id", dates.dedup_date().cast("string").alias("dedup"), dates.display_date().cast("string").alias("display"), dates.retention_date().cast("string").alias("retention"))
    return out.join(kept, "doc_id", "left").join(shown, "doc_id", "left").select("doc_id", "dedup", "display", "retention", F.coalesce("recent", F.lit(False)).alias("recent"), F.coalesce("last_week", F.lit(False)).alias("last_week"))


def prune_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, before, after = jobs.prune(full_records(spark, sf_dir), AS_OF, 30)
    return kept.select("doc_id", F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))


def validate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside a vocabulary, scores out of range, and credentials, in one table."""
    known = report.VOCABULARIES | {"record_type": ["publication", "clinical_trial"], "topics": ["CRISPR", "delivery"]}
    df = full_records(spark, sf_dir).withColumn("abstract", F.when(F.col("doc_id") % 17 == 0, F.concat("abstract", F.lit(" ghp_" + "a" * 36))).otherwise(F.col("abstract")))
    return jobs.validate(df, vocabularies=known, ranges={"relevance_score": (0, 90)}).select("id", "field", F.array_join("bad_values", ",").alias("bad"))


def export_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written facets and statistics, read back as (part, name, value)."""
    at = f"{shared_dir(spark)}/lexhoard-export-{uuid.uuid4().hex}"
    df = full_records(spark, sf_dir)
    clean = df.where("title not like '%token = %' and abstract not like '%KEY%'")
    jobs.export(clean, at, ["record_type", "modalities", "topics"])
    facets = spark.read.schema("facet string, value string, n long").json(f"{at}/facets").select(F.col("facet").alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value"))
    told = spark.read.schema("total long, included long, excluded long, changed long, mean_score double").json(f"{at}/statistics")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in told.columns]))
    counts = spark.read.schema("id string").json(f"{at}/records").agg(F.lit("files").alias("part"), F.lit("records").alias("name"), F.count("*").cast("double").alias("value"))
    newest = spark.read.schema("id string").json(f"{at}/latest").agg(F.lit("files").alias("part"), F.lit("latest").alias("name"), F.count("*").cast("double").alias("value"))
    return facets.unionByName(told.select(F.lit("statistics").alias("part"), cells.alias("c")).select("part", "c.*")).unionByName(counts).unionByName(newest)


QUERIES = {"all_views": all_views, "flat_csv": flat_csv, "record_dates": record_dates, "prune_job": prune_job, "validate_job": validate_job, "export_job": export_job}
_KEPT = f"retention BETWEEN DATE '{AS_OF}' - 29 AND DATE '{AS_OF}'"
SQL = {
    "all_views": f"WITH {_R} " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS view FROM r WHERE {condition}" for name, condition in _VIEWS.items()),
    "flat_csv": f"""WITH {_R} SELECT coalesce(CAST(display AS VARCHAR), '') AS date, title, 'https://e.org/' || doc_id AS url, evidence_level, array_to_string(modalities, '; ') AS modalities, array_to_string(delivery, '; ') AS delivery_systems, '' AS disease_areas, array_to_string(stages, '; ') AS development_stages,
CASE WHEN watched THEN 'ada; bo' ELSE '' END AS watched_people, CAST(CAST(score AS INTEGER) AS VARCHAR) AS relevance_score, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi, '' AS pmid, '' AS nct_id FROM d""",
    "record_dates": f"WITH {_R} SELECT doc_id, CAST(dedup AS VARCHAR) AS dedup, CAST(display AS VARCHAR) AS display, CAST(retention AS VARCHAR) AS retention, coalesce({_KEPT}, false) AS recent, coalesce(display BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}', false) AS last_week FROM d",
    "prune_job": f"WITH {_R} SELECT doc_id, (SELECT count(*) FROM d) AS before, (SELECT count(*) FROM d WHERE {_KEPT}) AS after FROM d WHERE {_KEPT}",
    "validate_job": f"""WITH {_R} SELECT id, 'record_type' AS field, record_type AS bad FROM r WHERE record_type = 'regulatory' UNION ALL SELECT id, 'topics', topics[1] FROM r WHERE len(topics) > 0 AND topics[1] NOT IN ('CRISPR', 'delivery')
UNION ALL SELECT id, 'relevance_score', CAST(score AS VARCHAR) FROM r WHERE score > 90 UNION ALL SELECT id, 'abstract', 'GitHub token' FROM r WHERE doc_id % 17 = 0""",
    "export_job": f"""WITH {_R}, k AS (SELECT * FROM r WHERE NOT contains(title, 'token = ') AND NOT contains(abstract, 'KEY')) SELECT 'record_type' AS part, record_type AS name, count(*)::DOUBLE AS value FROM k GROUP BY 2 UNION ALL SELECT 'modalities', m, count(*) FROM (SELECT unnest(modalities) AS m FROM k) GROUP BY 2 UNION ALL SELECT 'topics', t, count(*) FROM (SELECT unnest(topics) AS t FROM k) GROUP BY 2
UNION ALL SELECT 'statistics', 'total', count(*) FROM k UNION ALL SELECT 'statistics', 'included', count(*) FILTER (NOT excluded) FROM k UNION ALL SELECT 'statistics', 'excluded', count(*) FILTER (excluded) FROM k UNION ALL SELECT 'statistics', 'changed', count(*) FILTER (changed) FROM k UNION ALL SELECT 'statistics', 'mean_score', round_even(avg(score) FILTER (NOT excluded), 2) FROM k
UNION ALL SELECT 'files', 'records', count(*) FROM k UNION ALL SELECT 'files', 'latest', least(100, count(*) FILTER (NOT excluded)) FROM k""",
}
