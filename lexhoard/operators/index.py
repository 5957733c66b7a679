"""Search by an inverted table of trigrams: a query reads the lists of its rarest trigrams and verifies what they have in common."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the index's tables, and trigrams of a query whose lists are read.
BUCKETS, LISTS = 64, 3
#: Code points of texts whose trigrams are listed together.
LISTED = 4_000_000


def query_terms(query: str) -> list[str]:
    """Words of a query, as `search_normalize` has them."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if not unicodedata.combining(c)).lower()
    return re.findall(r"[^\W_]+", plain)


def _listed(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """(gram, n, ids): the distinct trigrams without spaces of each text (no term has others), and the texts that have them."""
    points = np.frombuffer(" ".join([*texts, "  "]).encode("utf-32-le"), "<u4").astype(np.uint64)
    free = points != 32
    grams = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    inside = free[:-2] & free[1:-1] & free[2:]
    found, at = [], 0
    for text in texts:
        found.append(np.unique(grams[at : at + len(text)][inside[at : at + len(text)]]))
        at += len(text) + 1
    grams, which = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    ends = np.append(first, len(grams))
    names = np.stack([(grams[first] >> np.uint64(x)) & np.uint64(2**21 - 1) for x in (42, 21, 0)], 1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(which[order])))
    return pa.RecordBatch.from_arrays([pa.array([names[i : i + 3] for i in range(0, len(names), 3)], pa.string()), pa.array(np.diff(ends), pa.int64()), lists], ["gram", "n", "ids"])


def _lists(batches):
    for batch in batches:
        start, texts, size = 0, [], 0
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            texts.append(text.decode("utf-8", "replace"))
            size += len(texts[-1])
            if size > LISTED or i == batch.num_rows - 1:
                yield _listed(batch.column(0).slice(start, len(texts)), texts)
                start, texts, size = i + 1, [], 0


def _bucket(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % BUCKETS).cast("int")


def write_search_index(df: DataFrame, path: str, id_col: str = "id", text_col: str = "search_text") -> None:
    """Writes the index of normalised texts: `lists` (gram, n, ids), `counts` (gram, n) and `texts` (id, text), each in folders by the
    hash of its key, sorted by it within files, so that both folders and row groups are skipped. A trigram has a list, of n ids, for
    each group of texts that are listed together, and only lists are shuffled; an id stands once in it for each of its rows. Null
    texts have no trigrams."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows.select("id").limit(0).write.mode("overwrite").parquet(f"{path}/ids")  # the type of ids, also if there are none
    rows.withColumn("bucket", _bucket(F.col("id"))).repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")
    texts = _table(df.sparkSession, path, "texts").select("id", "text")
    lists = texts.mapInArrow(_lists, f"gram string, n long, ids array<{texts.schema['id'].dataType.simpleString()}>").withColumn("bucket", _bucket(F.col("gram")))
    lists.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    counts = _table(df.sparkSession, path, "lists").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/ids").schema["id"].dataType.simpleString()
    columns = {"lists": f"gram string, n long, ids array<{kind}>", "counts": "gram string, n long", "texts": f"id {kind}, text string"}[table]
    return spark.read.schema(f"{columns}, bucket int").parquet(f"{path}/{table}")


def _of(spark: SparkSession, path: str, table: str, grams: list[str]) -> DataFrame:
    """Rows of the trigrams, from their folders only."""
    folders = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
    return _table(spark, path, table).where(F.col("bucket").isin(folders) & F.col("gram").isin(grams)).drop("bucket")


def search_candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """Ids that all of the query's LISTS rarest trigrams list; None if no term is long enough to have one."""
    grams = sorted({t[i : i + 3] for t in query_terms(query) for i in range(len(t) - 2)})
    if not grams:
        return None
    counts = {r["gram"]: r["n"] for r in _of(spark, path, "counts", grams).collect()}  # as many as the query has
    rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:LISTS]
    bit = F.coalesce(*(F.when(F.col("gram") == g, 1 << i) for i, g in enumerate(rarest)))  # bits and no count: an id may have two rows
    ids = _of(spark, path, "lists", rarest).select(bit.alias("bit"), F.explode("ids").alias("id"))
    return ids.groupBy("id").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == (1 << len(rarest)) - 1).select("id")


def search_indexed(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Ids of the texts in which every term of the query is a substring, as `search` finds them by a scan. Terms of one or two
    letters have no list; they are only verified, and a query of nothing else reads all texts."""
    texts, found = _table(spark, path, "texts").select("id", "text"), search_candidates(spark, path, query)
    out = texts if found is None else texts.join(found, "id", "left_semi")
    for term in query_terms(query):
        out = out.where(F.contains("text", F.lit(term)))
    return out.select("id")
