"""Mixing sources to target weights, in DataFrame operations only.

Words are summed up per source; the sources share a number of words by weight, where none may repeat its own words more often than
a limit; each source's repetition rate follows, and every document is taken floor(rate) times and once more with the probability
that is left, drawn from a hash of its id, so that reruns agree and no order or partitioning counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.llm.base import documents
from lexhoard.session import saved

#: Weights of the sources in code-point order, repeating; the words of the mix over all words; times a source may be repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix"
#: Sources up to which their table (about 50 bytes a row) is broadcast; beyond, it is joined by salted keys.
BROADCAST_SOURCES, SALTS = 50_000, 32
_DRAWS = 1 << 32


def document_sizes(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """(doc_id, source, size, draw) of every row, and with `keep` its columns as a struct `doc`: words of the text, runs of
    anything but white space (null: 0), and a number below 1 from the seed and the id (from the text where the id is null).
    Rows with one id have one draw."""
    words = F.size(F.array_remove(F.split(F.coalesce(text_col, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    draw = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / _DRAWS
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), draw.alias("draw")]
    return docs.select(*columns, *([F.struct("*").alias("doc")] if keep else []))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 in code-point order, null last. Rows are dealt by range and numbered within ranges, so that no task
    sees all of them."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = saved(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(before), "part").withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row per source of `sizes` (source, size), null being one.

    Sources weigh `weights` in turn, in code-point order, null last. Together they get `share` times all words, by weight; what a
    source would get beyond `most` times its own is shared again by weight among the others until none is above. If all are
    at their limit, or there are no words, each has its limit.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = saved(_ranked(totals).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit")))
    # Each round closes the sources that the level would take beyond their limit; the level of the others rises until none is.
    level, n_closed = 0.0, 0
    while True:
        closed = F.col("limit") < F.col("weight") * F.lit(level)
        found = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(closed, F.col("limit"))).alias("used"), F.sum(F.when(~closed, F.col("weight"))).alias("weight"), F.count_if(closed).alias("n")).first()
        if found["weight"] is None or (level and found["n"] == n_closed):
            break
        level, n_closed = ((found["all"] or 0) * share - (found["used"] or 0)) / found["weight"], found["n"]
        if level <= 0:
            break
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float(level)))
    return rows.select("source", "source_size", target.alias("target"))


def with_copies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_size, target and copies: floor(rate) times, and once more if the draw is below what is left of the rate, the
    target over the words of the source. Sources of no words are not taken."""
    right = saved(targets.withColumnsRenamed({"source": "of"}))
    if right.count() <= BROADCAST_SOURCES:
        joined = sizes.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("of")))
    else:
        salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
        many = right.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sizes.withColumn("salt", salt).join(many, (F.col("salt") == F.col("salt_of")) & F.col("source").eqNullSafe(F.col("of"))).drop("salt", "salt_of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).drop("of", "rate")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the number of the copy (from 0) as `copy`.

    A null text has no words, a null source is a source, null ids are told apart by their texts; an empty table gives an empty mix.
    Repeated rows are taken alike. Other columns stay; a column `copy` is an error.
    """
    if "copy" in docs.columns:
        raise ValueError("docs must not have a column named copy")
    sizes = document_sizes(docs, seed, id_col, text_col, source_col)
    taken = with_copies(document_sizes(docs, seed, id_col, text_col, source_col, keep=True), source_targets(sizes, weights, share, most))
    times: Column = F.sequence(F.lit(0), F.col("copies").cast("int") - 1)
    return taken.where("copies > 0").select("doc.*", F.explode(times).alias("copy"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`; texts are read once, their sizes kept."""
    sizes = saved(document_sizes(documents(spark, sf_dir)))
    return with_copies(sizes, source_targets(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_OP12 = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8))::BIGINT / 4294967296 AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (SELECT 0 AS i, 0::DOUBLE AS level, -1::BIGINT AS n UNION ALL
  SELECT i + 1, (SELECT (sum(source_size)::DOUBLE * 1.5 - coalesce(sum(2 * source_size) FILTER (2 * source_size < weight * level), 0)) / sum(weight) FILTER (2 * source_size >= weight * level) FROM s),
    (SELECT count(*) FILTER (2 * source_size < weight * level) FROM s) FROM l WHERE n < (SELECT count(*) FILTER (2 * source_size < weight * level) FROM s)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT arg_max(level, i) FROM l))::DOUBLE AS target FROM s),
r AS (SELECT doc_id, size, draw, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM r"""
