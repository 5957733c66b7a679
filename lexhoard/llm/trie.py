"""The prefix trie of conversations, by a splitter skeleton.

A conversation's path is the row of its turns' digests, 16 bytes each, so that paths as bytes sort as their turns do. Paths are
dealt into shards by ranges of (path, conv_id). The prefixes of the splitters between ranges are the skeleton: a node whose members
lie in two shards is a prefix of the splitter between them. The skeleton is broadcast; each shard, sorted, finishes all other
nodes in one pass with a stack, and gives partial aggregates of the skeleton's nodes, which are then reduced. As conv_id is part
of the range, a conversation that a third of all others repeat is dealt to many shards like any other rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.llm.base import crc32_sql
from lexhoard.session import saved, table

#: Bytes of a turn's digest in a path.
TURN = 16
#: Turns in a shard, sampled rows per splitter, and nodes that the skeleton may have: splitters are cut to as many turns as that
#: allows, which unbalances shards if more are shared, but never changes results.
SHARD_TURNS, SAMPLED, SKELETON_NODES = 200_000, 64, 500_000
#: Rows of a batch given out, and ids in a chunk of a skeleton node's list of conversations that end there.
OUT_ROWS, CHUNK_IDS = 10_000, 20_000
#: A conversation belongs to the family of the greatest multiple of FAMILY up to it, and takes fewer than HEADS turns of its first.
FAMILY, HEADS = 20, 4


def _lists(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, own): each conversation's turns in order, as (digest, words); families stay together in a partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    c = F.col("conv_id").cast("long")
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    turns = conversations.select((c - c % FAMILY).alias("family"), c.alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    listed = turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    return listed.withColumn("own", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))))


def _path(turns) -> list:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of conversations as they are. See `rebuilt_paths`."""
    return _lists(conversations).select("conv_id", *_path(F.col("own")))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation c after it is rebuilt: the first h turns of conversation c - c % 20 (all if it has
    fewer, none if it is absent), then its own after its first h, where h = crc32(c as decimal text) % 4.

    Turns stand in the order of turn (null first), then of role and of their digest; null role or text is the empty string; repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation. A path takes 16 bytes per turn in one row.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("family"))
    rows = _lists(conversations).withColumn("head", F.coalesce(head, F.slice("own", 1, 0))).withColumn("h", h)
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return rows.select("conv_id", *_path(turns))


def _splitters(paths: DataFrame, n_rows: int, n_shards: int) -> list[tuple[bytes, int]]:
    """At most n_shards - 1 rows (path, conv_id) that part the table evenly, from a sample by hash. Only balance depends on them."""
    every = max(1, n_rows // (SAMPLED * n_shards))
    cut = max(1, SKELETON_NODES // n_shards) * TURN
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id")
    n = sample.count()
    step = max(1, n // n_shards)
    at = F.row_number().over(Window.orderBy("path", "conv_id"))
    kept = sample.withColumn("at", at).where((F.col("at") % step == 0) & (F.col("at") < n)).select(F.substring("path", 1, cut).alias("path"), F.when(F.length("path") <= cut, F.col("conv_id")).alias("conv_id"))
    return sorted({(bytes(r["path"]), -(2**63) if r["conv_id"] is None else r["conv_id"]) for r in kept.collect()})


def skeleton_of(splitters: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Every prefix of the splitters' paths with a number; the root is 0, and prefixes come before what they are prefixes of."""
    numbers = {b"": 0}
    for path, _ in splitters:
        for end in range(TURN, len(path) + 1, TURN):
            numbers.setdefault(path[:end], len(numbers))
    return numbers


class _Node:
    __slots__ = ("ends", "first", "held", "kids", "leaves", "n", "number", "saved", "words")

    def __init__(self, words: int, number: int | None):
        self.words, self.number = words, number
        self.n = self.kids = self.leaves = self.saved = 0
        self.first, self.held = None, []
        self.ends = None  # of a node on the skeleton the ids of a chunk, of others the hash so far


NODE = pa.schema([("number", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_number", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("words", pa.int32()), ("shard", pa.int32()), ("seq", pa.int32()), ("chunk", pa.string())])
_NODE_SQL = "number int, conv_id long, depth long, parent_conv_id long, parent_number int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words int, shard int, seq int, chunk string"
_NO_ENDS = hashlib.sha256().hexdigest()


def shard_nodes(rows: Iterator[tuple[int, bytes, int, list[int]]], skeleton: dict[bytes, int]) -> Iterator[tuple]:
    """Rows of NODE from (shard, path, conv_id, words) sorted by the first three.

    A node that isn't on the skeleton lies in one shard and comes out whole, with its parent's conv_id or, where the parent is on
    the skeleton, its number. Of nodes on the skeleton come what this shard adds to them and the ids of conversations that end
    there in chunks. Held in memory: the nodes of the current path and the finished children of those not on the skeleton.
    """
    stack: list[_Node] = []
    shard, before, seq = None, b"", 0

    def chunk(node: _Node):
        nonlocal seq
        seq += 1
        ids, node.ends = node.ends, None
        return (node.number, *[None] * 10, shard, seq, ",".join(map(str, ids)))

    def close():
        node, depth = stack.pop(), len(stack) - 1
        above = stack[-1] if stack else None
        if above:
            above.n += node.n
            above.first = node.first if above.first is None else min(above.first, node.first)
        if node.number is not None:
            if node.ends:
                yield chunk(node)
            yield (node.number, node.first, depth + 1, None, None, node.n, node.kids, node.leaves, node.saved, None, node.words, shard, None, None)
            return
        for x in node.held:
            yield (*x[:3], node.first, *x[4:])
        saved_tokens, leaves = node.saved + (node.n - 1) * node.words, node.leaves or 1
        out = (None, node.first, depth + 1, None, above.number, node.n, node.kids, leaves, saved_tokens, node.ends.hexdigest() if node.ends else _NO_ENDS, None, None, None, None)
        if above.number is None:
            above.held.append(out)
        else:
            yield out
        above.kids += 1
        above.leaves += leaves
        above.saved += saved_tokens

    for number, path, conv_id, words in rows:
        if number != shard:
            while stack:
                yield from close()
            shard, before, seq = number, b"", 0
            stack.append(_Node(0, 0))
        depth, same = len(path) // TURN, 0
        while same < depth and path[same * TURN : same * TURN + TURN] == before[same * TURN : same * TURN + TURN]:
            same += 1
        while len(stack) > same + 1:
            yield from close()
        for d in range(same, depth):
            stack.append(_Node(words[d], skeleton.get(path[: (d + 1) * TURN]) if stack[-1].number is not None else None))
        node = stack[-1]
        node.n += 1
        node.first = conv_id if node.first is None else min(node.first, conv_id)
        if node.number is not None:
            node.ends = node.ends or []
            node.ends.append(conv_id)
            if len(node.ends) >= CHUNK_IDS:
                yield chunk(node)
        else:
            if node.ends:
                node.ends.update(f",{conv_id}".encode())
            else:
                node.ends = hashlib.sha256(str(conv_id).encode())
        before = path
    while stack:
        yield from close()


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _grown(skeleton: dict[bytes, int], rows: list) -> list[tuple]:
    """The skeleton's nodes, their subtrees summed up from the deepest. rows: the reduced partial aggregates, one per node."""
    kids, leaves, saved_tokens = ([0] * len(skeleton) for _ in range(3))
    found, out = {r["number"]: r for r in rows}, []
    for path in sorted(skeleton, key=len, reverse=True):
        at, up = skeleton[path], skeleton[path[:-TURN]] if path else None
        if (r := found.get(at)) is None:
            continue
        kids[at] += r["n_children"]
        leaves[at] = leaves[at] + r["n_leaves"] or 1
        saved_tokens[at] += r["saved_tokens"] + (r["n_convs"] - 1) * r["words"]
        out.append((at, r["conv_id"], len(path) // TURN, found[up]["conv_id"] if path else None, r["n_convs"], kids[at], leaves[at], saved_tokens[at]))
        if path:
            kids[up] += 1
            leaves[up] += leaves[at]
            saved_tokens[up] += saved_tokens[at]
    return out


def prefix_trie(paths: DataFrame, n_shards: int | None = None) -> DataFrame:
    """One row per distinct prefix of the paths (conv_id, path, words), the root included: conv_id, its smallest member; depth;
    parent_conv_id; n_convs, n_children, n_leaves and saved_tokens as the subtree has them; ends_sha256 over the ids of members that
    end there. Members are told apart by conv_id, which must not repeat. A conversation without turns is a member of the root
    alone. An empty table has no nodes. Paths are equal up to collisions of MD5."""
    spark = paths.sparkSession
    paths = saved(paths)
    size = paths.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("turns")).first()
    n_shards = n_shards or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size["turns"] // SHARD_TURNS)
    splitters = _splitters(paths, size["rows"], n_shards)
    skeleton = skeleton_of(splitters)
    shared = spark.sparkContext.broadcast((splitters, skeleton))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value[0]
        for b in batches:
            at = [bisect_right(cuts, x) for x in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["shard", "conv_id", "path", "words"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*[b.column(i).to_pylist() for i in (0, 2, 1, 3)], strict=True)

        yield from _batched(shard_nodes(rows(), shared.value[1]), NODE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, now = None, None
            for b in batches:
                for number, chunk in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if number != at:
                        if now:
                            yield at, now.hexdigest()
                        at, now = number, hashlib.sha256(chunk.encode())
                    else:
                        now.update(f",{chunk}".encode())
            if now:
                yield at, now.hexdigest()

        yield from _batched(rows(), pa.schema([("number", pa.int32()), ("ends", pa.string())]))

    dealt = paths.select("conv_id", "path", "words").mapInArrow(deal, "shard int, conv_id long, path binary, words array<int>")
    nodes = saved(dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(finish, _NODE_SQL))
    parts = nodes.where("number is not null and chunk is null")
    # As many rows as the skeleton has nodes, which are bounded.
    reduced = parts.groupBy("number").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words")).collect()
    grown = spark.createDataFrame(_grown(skeleton, reduced), "number int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    chunks = nodes.where("chunk is not null").select("number", "shard", "seq", "chunk")
    ends = chunks.repartition("number").sortWithinPartitions("number", "shard", "seq").mapInArrow(hashed, "number int, ends string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = grown.join(ends, "number", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS))).select(columns)
    parents = F.broadcast(grown.select(F.col("number").alias("parent_number"), F.col("conv_id").alias("_up")))
    rest = nodes.where("number is null").join(parents, "parent_number", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return top.unionByName(rest.select(columns))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `conversations`, rebuilt."""
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations")))


#: A node is named by its smallest member and its depth. Subtrees are listed through members, which only small tables allow.
ORACLE_OP13 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS own FROM t GROUP BY 1),
b AS (SELECT o.conv_id, coalesce(f.own[1:h], []) || o.own[h + 1:] AS path FROM (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM o) o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, unnest(range(len(path) + 1)) AS d, path FROM b),
m AS (SELECT conv_id, d, len(path) AS turns, path[d].text AS text, min(conv_id) OVER (PARTITION BY d, path[1:d]) AS node FROM p),
n AS (SELECT node, d, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(regexp_split_to_array(any_value(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS saved FROM m GROUP BY 1, 2),
u AS (SELECT DISTINCT m.node, m.d, a.node AS up FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.d = m.d - 1),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS n FROM u WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT DISTINCT a.node, a.d, m.node AS sub, m.d AS sub_d FROM m a JOIN m ON m.conv_id = a.conv_id AND m.d >= a.d),
g AS (SELECT s.node, s.d, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves FROM s JOIN n ON n.node = s.sub AND n.d = s.sub_d LEFT JOIN k ON k.node = s.sub AND k.d = s.sub_d GROUP BY 1, 2)
SELECT n.node AS conv_id, n.d AS depth, u.up AS parent_conv_id, n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM n JOIN u USING (node, d) JOIN g USING (node, d) LEFT JOIN k USING (node, d)"""
