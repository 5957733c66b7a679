"""Duplicate edges and greedy clustering against plain replays."""

import difflib
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexhoard.graph import connected_components
from lexhoard.operators import dedup

AUTHORS = "array<struct<name:string,given_name:string,family_name:string,orcid:string>>"


def _greedy(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[max(a, b)].add(min(a, b))
    kept, out = set(), {}
    for x in sorted({i for e in edges for i in e if i is not None}):
        first = min((y for y in near[x] if y in kept), default=None)
        out[x] = x if first is None else first
        if first is None:
            kept.add(x)
    return out


@pytest.mark.parametrize("n,m", [(30, 25), (40, 80), (25, 150)])
def test_greedy_equals_replay(spark, n, m):
    rng = random.Random(n * m)
    edges = [(f"{rng.randrange(n):03}", f"{rng.randrange(n):03}") for _ in range(m)] + [("900", "900"), (None, "901")]
    out = dedup.cluster_greedy(spark.createDataFrame(edges, "left_id string, right_id string"))
    assert {r["id"]: r["cluster"] for r in out.collect()} == _greedy(edges)


def test_greedy_of_a_chain_and_of_nothing(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(9)]
    got = {r["id"]: r["cluster"] for r in dedup.cluster_greedy(spark.createDataFrame(chain, "left_id string, right_id string")).collect()}
    assert got == _greedy(chain) and got["001"] == "000" and got["002"] == "002" and got["009"] == "008"
    assert dedup.cluster_greedy(spark.createDataFrame([], "left_id string, right_id string")).count() == 0


def test_deduplicate_modes_differ_on_a_bridge(spark):
    rows = [(i, ["rss"], f"t{i}", False) for i in "abc"]
    df = spark.createDataFrame(rows, "id string, source_types array<string>, title string, excluded boolean")
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "y", 0.9)], "left_id string, right_id string, reason string, confidence double")
    sizes = lambda mode: sorted(r["n_members"] for r in dedup.deduplicate(df, edges, ["title"], [], mode=mode)[0].collect())
    assert sizes("components") == [3] and sizes("greedy") == [1, 2]


def test_preprint_stars(spark):
    rng = random.Random(4)
    rows = [(f"{i:03}", rng.choice([None, "10.1/a", "10.1/b", "10.1/c"]), rng.choice([None, None, "https://doi.org/10.1/A", "10.1/b", "10.1/d"])) for i in range(40)]
    out = dedup.preprint_edges(spark.createDataFrame(rows, "id string, doi string, published string"), F.col("published"), F.col("doi"))
    bare = lambda d: d and d.lower().removeprefix("https://doi.org/")
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] and a[1] == bare(b[2])]
    parts = lambda df: {r["node"]: r["component"] for r in connected_components(df, "left_id", "right_id").collect()}
    assert parts(out) == parts(spark.createDataFrame(pairs, "left_id string, right_id string"))
    edges = {(r["left_id"], r["right_id"]) for r in out.collect()}
    assert edges <= set(pairs) and len(edges) < sum(bool(r[1]) + bool(r[2]) for r in rows) < len(pairs)


def _titles(n, seed):
    rng = random.Random(seed)
    words = "the of lipid particle delivery in mouse liver model study with long range small cell type two new".split()
    titles = [" ".join(rng.choices(words, k=rng.randint(4, 14))) for _ in range(n // 12)]
    out = []
    for i in range(n):
        t = rng.choice(titles)
        if rng.random() < 0.6:
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "x", "ab"]) + t[at + rng.choice([0, 1]) :]
        given = rng.choice(["Ada", "Ada", "A", "Bob", ""])
        out.append((f"{i:04}", t, [(f"{given} Doe".strip(), given, rng.choice(["Doe"] * 5 + ["Roe"]), rng.choice([None] * 8 + ["0-1", "0-2"]))], rng.choice([2020, 2021, 2024, None])))
    return out


def _title_pairs(rows):
    def parts(a):
        return a[2].lower(), a[1].lower() or (a[0].split()[0].lower() if len(a[0].split()) > 1 else ""), a[3]

    def same(x, y):
        (fx, gx, ox), (fy, gy, oy) = parts(x), parts(y)
        if fx != fy:
            return False
        if ox and oy:
            return ox == oy
        return bool(gx and gy) and (gx == gy or (min(len(gx), len(gy)) == 1 and gx[0] == gy[0]))

    found = set()
    for a, b in itertools.combinations(rows, 2):
        ta, tb = (" ".join(t.split()) for t in (a[1], b[1]))
        wa, wb = ta.split(), tb.split()
        if not same(a[2][0], b[2][0]) or (a[3] and b[3] and abs(a[3] - b[3]) > 2):
            continue
        jaccard = len(set(wa) & set(wb)) / len(set(wa) | set(wb))
        if (ta == tb and len(wa) >= 5) or (min(len(wa), len(wb)) >= 8 and jaccard >= 0.72 and difflib.SequenceMatcher(None, ta, tb, autojunk=False).ratio() >= 0.96):
            found.add((a[0], b[0]))
    return found


@pytest.mark.parametrize("cell_rows", [2000, 7])
def test_title_edges_equal_brute_force(spark, monkeypatch, cell_rows):
    """Components of all pairs; every edge is a pair; pairs of different classes' first members are all there."""
    monkeypatch.setattr(dedup, "CELL_ROWS", cell_rows)
    rows = _titles(160, 3)
    schema = f"id string, title string, authors {AUTHORS}, year int"
    edges = dedup.title_edges(spark.createDataFrame(rows, schema))
    got, want = {(r["left_id"], r["right_id"]) for r in edges.collect()}, _title_pairs(rows)
    assert len(want) > 100 and got <= want
    parts = lambda pairs: {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(sorted(pairs), "left_id string, right_id string"), "left_id", "right_id").collect()}
    assert parts(got) == parts(want)
    first = {}
    for i, t, a, y in rows:
        first.setdefault((" ".join(t.split()), str(a), y), i)
    assert got >= {(a, b) for a, b in want if a in first.values() and b in first.values()}


def test_formulaic_titles_of_one_family_are_dealt(spark, monkeypatch):
    """No cell holds more than a share of the rows of a hot block."""
    monkeypatch.setattr(dedup, "CELL_ROWS", 500)
    rng = random.Random(1)
    make = lambda i: f"annual report of the society on its many works number {i} by {rng.getrandbits(60):x} and {rng.getrandbits(60):x}"
    rows = spark.createDataFrame([(f"{i:05}", make(i)) for i in range(10_000)], "id string, title string")
    left, right = dedup._blocks(rows.withColumn("family", F.lit("wang")).withColumn("w", F.lit("annual")))
    assert left.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 700
    assert right.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 700
    authors = F.array(F.struct(F.lit("Li Wang").alias("name"), F.lit("Li").alias("given_name"), F.lit("Wang").alias("family_name"), F.lit(None).cast("string").alias("orcid")))
    assert dedup.title_edges(rows.select("id", "title", authors.alias("authors"), F.lit(2020).alias("year"))).count() == 0
