"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Each starts in the shard its key hashes to; then, round by round, linked documents move
to the shard that holds most of their neighbours, as far as that shard's quota allows. Neighbours are counted per (text,
shard), never listed, so a text that a third of all rows share costs no more than others. Unlinked documents fill what
remains, and a last exact step makes the row counts of the shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.llm.base import documents
from lexhoard.session import saved

SHARDS = 16
ROUNDS = 4
#: Rows in a cell, the unit in which rows of a shard are numbered.
CELL_ROWS = 5000


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per input row.

    Law `rows`: shard s holds floor(n / n_shards) rows, or one more if s < n mod n_shards; slots run from 0 without gaps.
    size is the UTF-8 bytes of the text plus 1. A null text has size 1, crc 0 and no links; an empty table gives no rows.
    Repeated rows are linked, like any equal texts.
    """
    text = F.col(text_col)
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(id_col, text_col).alias("k"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("g"),
        )
    )
    n = rows.count()
    groups = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n_g")).where("n_g > 1").select("g", F.lit(False).alias("single"))
    start = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(n_shards)).cast("int")
    now = saved(rows.join(groups, "g", "left").select("doc_id", "k", "size", "text_crc32", "g", F.coalesce("single", F.lit(True)).alias("single"), start.alias("shard")))
    for turn in range(rounds):
        now = saved(_moved(now, n / n_shards, n_shards, turn))
    return _evened(now, n, n_shards)


def _literal(values) -> F.Column:
    return F.array(*[F.lit(x) for x in values])


def _moved(now: DataFrame, quota: float, n_shards: int, turn: int) -> DataFrame:
    """Linked documents ask for the shard with most of their text's rows that has room; a shard grants as many as fit."""
    linked = now.where("not single")
    counts = linked.groupBy("g", "shard").agg(F.count("*").alias("n"))
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # n_shards rows
    room = [quota - load.get(s, 0) for s in range(n_shards)]
    wanted = counts.where(F.element_at(_literal(room), F.col("shard") + 1) > 0).groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("to"))
    asking = counts.join(wanted, "g").where("shard != to.shard and (to.n > n or (to.n = n and to.tie > xxhash64(g, shard)))").select("g", "shard", "n", F.col("to.shard").alias("to"))
    flow = asking.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # at most n_shards ** 2 rows
    into, out = [0] * n_shards, [0] * n_shards
    for r in flow:
        into[r["to"]] += r["n"]
        out[r["shard"]] += r["n"]
    share = [min(1.0, max(0.0, room[s] + out[s] / 2) / into[s]) if into[s] else 0.0 for s in range(n_shards)]
    granted = F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(1 << 20)) < F.element_at(_literal(share), F.col("to") + 1) * float(1 << 20)
    moves = now.join(asking.select("g", "shard", "to"), ["g", "shard"], "left")
    return moves.select("doc_id", "k", "size", "text_crc32", "g", "single", F.when(F.col("to").isNotNull() & granted, F.col("to")).otherwise(F.col("shard")).alias("shard"))


def _evened(now: DataFrame, n: int, n_shards: int) -> DataFrame:
    """Numbers the rows of each shard, unlinked ones last, and passes what is over a shard's share on to those under theirs."""
    cells = max(1, n // n_shards // CELL_ROWS)
    rows = now.withColumn("cell", F.pmod(F.xxhash64("k", F.lit(17)), F.lit(cells)).cast("int"))
    at = Window.partitionBy("shard").orderBy("single", "cell")
    counts = rows.groupBy("shard", "single", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "single", "cell", (F.sum("n").over(at) - F.col("n")).alias("before"))
    held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # n_shards rows
    share = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    over = [max(0, held.get(s, 0) - share[s]) for s in range(n_shards)]
    under = [max(0, share[s] - held.get(s, 0)) for s in range(n_shards)]
    over_from = [sum(over[:s]) for s in range(n_shards)]
    takes = [s for s in range(n_shards) if under[s]] or [0]
    under_from = [sum(under[:s]) for s in takes]

    in_cell = Window.partitionBy("shard", "single", "cell").orderBy("k", "doc_id")
    numbered = rows.withColumn("i", F.row_number().over(in_cell) - 1).join(offsets, ["shard", "single", "cell"]).withColumn("slot", F.col("i") + F.col("before"))
    of = lambda values, s: F.element_at(_literal(values), s + 1)
    rest = F.col("slot") - of(share, F.col("shard"))
    numbered = numbered.withColumn("e", F.when(rest >= 0, rest + of(over_from, F.col("shard"))))
    numbered = numbered.withColumn("j", F.size(F.filter(_literal(under_from), lambda x: x <= F.col("e"))) - 1)
    passed = F.col("e").isNotNull()
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(passed, of(takes, F.col("j"))).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(passed, F.col("e") - of(under_from, F.col("j")) + of([held.get(s, 0) for s in takes], F.col("j"))).otherwise(F.col("slot")).cast("long").alias("slot"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`, by law `rows`."""
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
