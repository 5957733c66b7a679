"""Landed payloads: readers that keep each payload as it came, parsing beside it, and rows that can't be used in a table of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.functions.ids import raw_sha256
from lexhoard.session import saved
from lexhoard.sources import normalize

_BAD = "_corrupt_record"
_OPENED = re.compile(rb"<(item|entry)[\s>]")
#: Bytes of items in a batch that goes back to Spark; one more item may come on top.
_BATCH = 1 << 22


def read_xml_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(raw, file): each element of that name, as text. Files are split by the end tag, so that large ones are read by many tasks."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.concat(F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0), F.lit(f"</{tag}>")).alias("raw"), F.col("_metadata.file_path").alias("file"))
    return rows.where(F.startswith("raw", F.lit(f"<{tag}")))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file): each line that isn't blank."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))


def read_feed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file): each item and entry of RSS and Atom files, from its tag to the next end tag of that name.

    Files are read in pieces, cut at "</", by many tasks. A file's pieces come in order to one task, led by the number of end tags
    that the file has of either name, and are put together as they stream by: no more than one item is held, however large the file.
    Then items are dealt out evenly, as what is done with them takes longer.
    """
    read = spark.read.option("lineSep", "</").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    ends = [F.count_if(F.startswith("value", F.lit(f"{tag}>"))).alias(tag) for tag in ("item", "entry")]
    first = read.groupBy("file").agg(*ends).withColumn("start", F.lit(-1).cast("long"))
    rows = read.withColumn("value", F.col("value").cast("binary")).unionByName(first, allowMissingColumns=True)
    ordered = rows.repartition("file").sortWithinPartitions("file", "start", "at")
    return ordered.select("file", "start", "value", "item", "entry").mapInArrow(_joined, "raw string, file string").hint("rebalance")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(raw, file) from a file's pieces. A tag that no end tag follows in its file opens nothing, and what comes after it counts."""
    out, size, tag, held, left = [], 0, b"", [], {}
    for b in batches:
        for file, start, value, items, entries in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if start < 0:
                tag, held, left = b"", [], {b"item": items, b"entry": entries}
                continue
            end = next((t for t in left if value.startswith(t + b">")), b"")
            if end:
                left[end] -= 1
            if tag and tag != end:
                held.append(value)
                continue
            if tag:
                raw = b"</".join([*held, tag + b">"])
                out.append((raw.decode("utf-8", "replace"), file))
                size += len(raw)
            opened = next((m for m in _OPENED.finditer(value) if left[m[1]]), None)
            tag, held = (opened[1], [value[opened.start() :]]) if opened else (b"", [])
            if size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["raw", "file"])
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["raw", "file"])


def parsed(landed: DataFrame, schema: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """(landed rows with the payload's fields as columns, rows that aren't well-formed). Nothing of the landed string is lost.
    Every row is parsed once: the parsed rows are written, as each filter and field that is read of them would parse them anew."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    full = f"{schema}, {_BAD} STRING"
    value = F.from_xml("raw", full, options) if fmt == "xml" else F.from_json("raw", full, options)
    rows = saved(landed.withColumn("payload", value))
    broken = F.col("payload").isNull() | F.col(f"payload.{_BAD}").isNotNull()
    return rows.where(~broken).select(*landed.columns, "payload.*").drop(_BAD), rows.where(broken).select(*landed.columns)


#: By source: format of a landed row, schema of its payload, and the normalizer.
SOURCES = {
    "pubmed": ("xml", normalize.ARTICLE_SCHEMA, normalize.normalize_pubmed),
    "clinicaltrials": ("json", normalize.STUDY_SCHEMA, normalize.normalize_trials),
    "biorxiv": ("json", normalize.PREPRINT_PAGE_SCHEMA, lambda df, rejects: normalize.normalize_preprints(df, "biorxiv", rejects)),
    "medrxiv": ("json", normalize.PREPRINT_PAGE_SCHEMA, lambda df, rejects: normalize.normalize_preprints(df, "medrxiv", rejects)),
    "crossref": ("json", normalize.WORK_SCHEMA, normalize.normalize_crossref),
}


def normalized(landed: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of landed rows (raw, and retrieved_at if known) of a source. rejected: source, reason, raw_sha256, raw."""
    fmt, schema, normalizer = SOURCES[source]
    rows, broken = parsed(landed, schema, fmt)
    return _parted(normalizer(rows, rejects=True), broken, source)


def normalized_feeds(landed: DataFrame, feeds: DataFrame, per_feed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of landed items and entries (feed, raw) of all feeds in one go. See `normalize_feeds`."""
    rows, broken = parsed(landed, normalize.ENTRY_SCHEMA, "xml")
    return _parted(normalize.normalize_feeds(rows, feeds, per_feed, rejects=True), broken, "rss")


def _parted(out: DataFrame, broken: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    out = saved(out)  # a filter by `reject` would be pushed ahead of the normalizer and work out again what it looks at
    reject = lambda df, reason: df.select(F.lit(source).alias("source"), reason.alias("reason"), raw_sha256(F.col("raw")).alias("raw_sha256"), "raw")
    rejected = reject(out.where("reject is not null"), F.col("reject")).unionByName(reject(broken, F.lit("not well-formed")))
    return out.where("reject is null").drop("reject", "raw"), rejected


def read_numbered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of JSON lines: the parsed rows, and (file, line, value) of lines that can't be read, with their numbers from 1.

    A line's number is its rank by its place in the file. Spark gives no place within a file, but the split that a line is read
    in and its order there; so lines are counted per split, the counts summed up in the order of splits, and only bad lines are
    numbered, by their order in the split. No task sees a whole file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    full = f"{schema}, {_BAD} STRING"
    read = saved(lines.withColumn("row", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})))
    broken = (F.trim("value") != "") & (F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull())
    splits = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row per split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = read.where(broken).join(splits.withColumn("before", before), ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")
    return read.where(~broken & (F.trim("value") != "")).select("row.*").drop(_BAD), bad


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines; a line that can't be read is an error that names its file and number."""
    rows, bad = read_numbered(spark, path, schema)
    if (first := bad.orderBy("file", "line").first()) is not None:
        raise ValueError(f"{first['file']}, line {first['line']}: not a record: {first['value'][:200]}")
    return rows
