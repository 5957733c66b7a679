"""The corpus pipeline: five stages, each over all that the one before has kept.

`documents` -> toxicity (rejected documents go) -> near duplicates (one document of each group stays) -> benchmark decontamination
(contaminated documents go) -> PII (identifiers are masked) -> best-fit packing. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import documents
from lexhoard.llm.decontaminate import find_benchmark
from lexhoard.llm.jaccard import jaccard_components
from lexhoard.llm.packing import pack_documents
from lexhoard.llm.pii import mask_pii
from lexhoard.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from lexhoard.session import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(COLUMNS), model).where(F.col("toxicity") < THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group, once; texts without words are no duplicates of each other."""
    found = jaccard_components(docs)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("k"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "k"]).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return find_benchmark(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where(F.size("bench_spans") == 0).select(COLUMNS)


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks identifiers; n_chars follows the masked text and stays null where it was."""
    masked = mask_pii(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_identifiers),
    ("packing", pack),
]

#: Deobfuscation, connected components and best-fit packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
