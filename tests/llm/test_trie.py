"""The conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from lexhoard.llm import trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _words(text):
    return sum(1 for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w)


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role or "", digest, text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def brute(paths):
    """Rows of every node by listing the members of every prefix."""
    members = defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    rows = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parent = [n for n in (node[:-1],) if node]
        ends = sorted(c for c in who if len(paths[c]) == len(node))
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * _words(n[-1][1]) for n in below if n)
        kids = sum(len(n) == len(node) + 1 for n in below)
        rows.append((min(who), len(node), min(members[parent[0]]) if parent else None, len(who), kids, len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def _made():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 47), 60, 61, 62, 63, 64, 65, 66, 105, 121]:
        for t in range(rng.choice([1, 2, 3, 4, 5, 6])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "hello", "x\ty z", "same words here"]), "p", 1, 1))
    hot = [(t, "user", f"turn {t} of the same") for t in range(7)]
    rows += [(c, *x, "p", 1, 1) for c in range(200, 290) for x in hot]
    rows += [(500, t, "user", "long " + str(t // 3), "p", 1, 1) for t in range(300)]
    rows += [rows[0], rows[0], (None, 1, "user", "nobody's", "p", 1, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n_shards", [1, 5, 40])
def test_trie(spark, n_shards):
    rows = _made()
    df = spark.createDataFrame(rows, SCHEMA)
    out = trie.prefix_trie(trie.rebuilt_paths(df), n_shards)
    assert out.columns == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(_rebuilt(rows))


def test_trie_hot_copies_are_dealt_and_cut_splitters_do_no_harm(spark, monkeypatch):
    rows = _made()
    paths = trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA))
    cuts = trie._splitters(paths, paths.count(), 40)
    assert max(map(len, map(list, _shares(cuts, paths)))) < 30
    monkeypatch.setattr(trie, "SKELETON_NODES", 80)
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    assert sorted((tuple(r) for r in trie.prefix_trie(paths, 40).collect()), key=str) == brute(_rebuilt(rows))


def _shares(cuts, paths):
    from bisect import bisect_right

    shares = defaultdict(list)
    for r in paths.collect():
        shares[bisect_right(cuts, (bytes(r["path"]), r["conv_id"]))].append(r["conv_id"])
    return shares.values()


def test_trie_edges(spark):
    assert trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame([], SCHEMA))).collect() == []
    # 5 takes 0 to 3 turns of conversation 0, which is absent; its own single turn goes if it takes any.
    rows = [(c, 0, None, None, None, None, None) for c in (5, 7, 9)]
    out = trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(_rebuilt(rows))
    plain = trie.prefix_trie(trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((r["depth"], r["n_convs"]) for r in plain.collect()) == [(0, 3), (1, 3)]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in trie.op13_trie(spark, SF).select(COLUMNS).collect()), key=str)
    assert got == brute(_rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLE_OP13})").fetchall(), key=str)


def test_trie_sql_on_odd_rows(spark):
    """Null turns, ties, repeated rows and absent first conversations mean the same to the SQL."""
    made = pd.DataFrame(_made(), columns=["conv_id", "turn", "role", "text", "path", "words", "n"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", made)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLE_OP13})").fetchall(), key=str) == brute(_rebuilt(_made()))
