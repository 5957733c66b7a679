"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.session import table

#: Rows in an Arrow batch for functions over whole texts, so that a batch of long texts fits in a Python worker.
BATCH_ROWS = 2000
#: Words of the contracts that lower-case A-Z and split on everything ASCII but digits and letters.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate tables over UTF-8: bytes from 0x80 on belong to letters and stay.
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORDS_OF = bytes(x if x >= 0x80 else LOWERED[x] if re.match(WORD, chr(LOWERED[x])) else 0x20 for x in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def arrow_sized(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, as whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, k): only the columns in use, so extra columns with any name do not clash. k tells documents apart;
    rows with equal doc_id and text share it."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("k"))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): each doc_id once, if its rows that hold 0 or 1 agree."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
    return known.agg(F.min(label).alias(label), F.max(label).alias("most")).where(F.col(label) == F.col("most")).drop("most")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """From batches sorted by their first column: the rows of each of its values together. Only for keys of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held)


def crc32_sql(x: str) -> str:
    """The SQL expression of crc32(UTF-8 of x), for oracles: bytes are folded one by one, each by eight shifts."""
    byte = f"('0x' || substr(hex(encode({x})), (2 * i + 1)::INTEGER, 2))::BIGINT"
    shifts = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda i: {byte})), lambda c, b: {shifts}), 4294967295)"
