"""Mixing of sources against a plain replay of its rules, and the registered query against its SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from lexhoard.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int, target string, doc string"


def _rows():
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{i % 3}", 1, "x", "y") for i in range(60)]
    rows += [(100, None, "s0", 1, "x", "y"), (101, "", "only empty", 1, "x", "y"), (None, "no id", "s1", 1, "x", "y"), (None, "no id either", None, 1, None, None)]
    rows += [(102, "\t\n a\xa0b  c\x0b", None, 1, "x", "y"), (103, "é " * 5000, "É", 1, "x", "y"), rows[3], rows[3]]
    return rows


def _levels(sizes, weights, share, most):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), sum(sizes.values()) * share
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += left * weight[s] / total
        left = sum(max(0.0, got[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if got[s] >= most * sizes[s]:
                got[s] = most * sizes[s]
                open_.discard(s)
    return got


def test_mixing_replays_by_hand(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = defaultdict(int)
    for _, t, s, *_ in rows:
        sums[s] += size(t)
    want = _levels(sums, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    sizes = mixing.document_sizes(df)
    targets = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    assert {s: r["source_size"] for s, r in targets.items()} == dict(sums)
    assert {s: r["target"] for s, r in targets.items()} == pytest.approx(want)
    copies = {}
    for i, t, s, *_ in rows:
        rate = want[s] / sums[s] if sums[s] else 0
        name = str(i) if i is not None else t or ""
        draw = int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:8], 16) / 2**32
        copies[(i, t)] = int(rate) + (draw < rate - int(rate))
    out = mixing.with_copies(sizes, mixing.source_targets(sizes)).collect()
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in out) == sorted((str(i), size(t), copies[(i, t)]) for i, t, *_ in rows)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == [*df.columns, "copy"]
    assert sorted((str(r["doc_id"]), str(r["text"]), r["copy"], str(r["target"])) for r in mixed.collect()) == sorted((str(r[0]), str(r[1]), c, str(r[4])) for r in rows for c in range(copies[r[:2]]))


def test_mixing_does_not_depend_on_partitions_or_joins(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), SCHEMA)
    take = lambda d: sorted(map(str, mixing.with_copies(s := mixing.document_sizes(d), mixing.source_targets(s)).select("doc_id", "size", "target", "copies").collect()))
    want = take(df)
    assert take(df.repartition(7, "text")) == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert take(df.repartition(3, "source")) == want


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 1, "x", "y"), (2, " ", None, 1, "x", "y")], SCHEMA)
    sizes = mixing.document_sizes(blank)
    assert [(r["size"], r["target"], r["copies"]) for r in mixing.with_copies(sizes, mixing.source_targets(sizes)).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix_documents(empty.withColumnRenamed("doc", "copy"))


def test_mixing_query(spark):
    got = sorted(tuple(r) for r in mixing.op12_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE_OP12})").fetchall())
