"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most one sequence. Within a block of bounded size, dealt by the hash of the document, pieces
are placed largest first. Open bins are kept in order of the room they have left; each carries a bitmap of the sources that it
may take no more of and a bitmap of duplicate clusters. The search starts at the tightest bin that has room and goes on to the
successors until one is compatible; if none is, a new bin is opened. A bin that is full, or may take no source more, is closed.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import documents

#: Words in a sequence.
CAPACITY = 2048
#: Pieces of one source that a sequence may hold, or this many times the source's even share of the block's sequences if that is
#: more: sources mix as far as the block offers others, and a block of one source still fills its sequences.
MAX_PER_SOURCE, EVEN_SHARE = 2, 1.5
#: Documents in a block, the unit of one task's work.
BLOCK_ROWS = 10_000


def pack_block(sizes: list[int], sources: list, clusters: list, capacity: int, max_per_source: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each piece. Pieces of equal size keep their order, so equal input gives equal bins. Pieces of no
    words conflict with nothing."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    every = (1 << len(source_bit)) - 1
    full_bins = max(1, -(-sum(sizes) // capacity))
    limit = {s: max(max_per_source, math.ceil(EVEN_SHARE * n / full_bins)) for s, n in Counter(s for s, n in zip(sources, sizes, strict=True) if n).items()}
    seen, cluster_bit = set(), {}  # only clusters that occur twice need a bit
    for c in clusters:
        if c in seen and c not in cluster_bit:
            cluster_bit[c] = 1 << len(cluster_bit)
        seen.add(c)
    bins, offsets, order = [0] * len(sizes), [0] * len(sizes), []
    left, shut, held, counts = [], [], [], []  # of each bin: room, bitmaps of sources and clusters, pieces of each source
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, source = sizes[i], sources[i]
        s, c = (source_bit[source], cluster_bit.get(clusters[i], 0)) if n else (0, 0)
        for at in range(bisect_left(order, (n, -1)), len(order)):
            b = order[at][1]
            if not (shut[b] & s or held[b] & c):
                del order[at]
                break
        else:
            b = len(left)
            left.append(capacity)
            shut.append(0)
            held.append(0)
            counts.append(Counter())
        bins[i], offsets[i] = b, capacity - left[b]
        left[b] -= n
        held[b] |= c
        if n:
            counts[b][source] += 1
            if counts[b][source] >= limit[source]:
                shut[b] |= s
        if left[b] > 0 and shut[b] != every:
            insort(order, (left[b], b))
    return bins, offsets


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, piece, bin, bin_offset, n_words, word_from): one row per piece.

    Sizes are words (runs without white space). A text of more than `capacity` words becomes several pieces, all of them placed;
    null, empty and blank texts have one piece of no words, which may stand in any open bin. No bin holds more than `capacity`
    words, two pieces with words of one cluster, or more pieces with words of one source than `max_per_source` or EVEN_SHARE times
    the source's pieces in the block over the sequences that the block's words fill. A null source is a source. Clusters are equal
    texts unless `cluster_col` names them. Full pieces of a long text fill a bin each. Repeated rows are equal texts.
    """
    words = F.size(F.array_remove(F.split(F.coalesce(text_col, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(cluster_col or text_col).alias("cluster"), F.xxhash64(id_col, text_col).alias("k"), words.alias("words"))
    n = docs.count()
    blocks = max(1, -(-n // block_rows))
    pieces = rows.withColumn("piece", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0))).cast("array<int>")))
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity))).withColumn("block", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "piece", "n_words", "cluster", "source"], kind="stable")
        bins, offsets = pack_block(pdf["n_words"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity, max_per_source)
        block = pdf["block"].astype(str)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "bin": block + "-" + pd.Series(bins, pdf.index).astype(str), "bin_offset": offsets, "n_words": pdf["n_words"], "word_from": pdf["piece"] * capacity})

    id_type = rows.schema[0].dataType.simpleString()
    return pieces.select("doc_id", "source", "cluster", "k", "piece", "n_words", "block").groupBy("block").applyInPandas(pack, f"doc_id {id_type}, piece int, bin string, bin_offset int, n_words int, word_from int")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed; clusters are equal texts."""
    return pack_documents(documents(spark, sf_dir))
