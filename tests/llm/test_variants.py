"""Spelling variants against brute force: the index on made words, the operator on small texts, the query against its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexhoard import session
from lexhoard.llm import variants

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n string, root string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def _near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _rows(counts):
    """Rows of COLUMNS for words and their counts."""
    out = []
    near = {w: [x for x in counts if _near(w, x)] for w in counts}
    forms = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(near[w]), counts.get(forms[w])))
    return sorted(out)


def _counts(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _made(letters, n, most, rng):
    words = {"".join(rng.choices(letters, weights=range(len(letters), 0, -1), k=rng.randint(5, most))) for _ in range(n)}
    for w in rng.sample(sorted(words), n // 3):
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]}
    return sorted(w for w in words if len(w) >= 5)


@pytest.mark.parametrize("letters,most", [("ab", 9), ("abcdé", 8), ("abcdefghijklmnoÿ", 14)])
@pytest.mark.parametrize("share", [0, 3, 16, 200, None])
def test_near_words_share_a_key(letters, most, share):
    words = _made(letters, 250, most, random.Random(f"{letters}{share}"))
    grams, n = np.unique(variants.all_grams(words), return_counts=True)
    frequent = None if share is None else grams[n * share > len(words)]
    keys = [set() for _ in words]
    for w, key, check in zip(*variants.index_keys(words, frequent), strict=True):
        keys[w].add((key, check))
    met = 0
    for i, a in enumerate(words):
        for j in range(i):
            if _near(a, words[j]):
                met += 1
                assert keys[i] & keys[j], (a, words[j])
            elif share is None:
                assert not keys[i] & keys[j], (a, words[j])
    assert met > 20


def test_decompose_by_hand():
    """Frequent "an": from a, "an" goes on to "ana"; what ends with it is left out for the gram that starts before."""
    words = ["banana"]
    codes, starts = variants._codes(words)
    grams = variants.all_grams(words)
    pack = lambda s: int(grams[[i for i, x in enumerate(_strings("\x01banana\x02")) if x == s][0]])
    none = variants.decompose(codes, starts, np.zeros(0, np.int64))
    assert none[0].tolist() == list(range(7)) and none[1].tolist() == list(range(1, 8))
    first, last, reach = variants.decompose(codes, starts, np.array([pack("an")], np.int64))
    assert list(zip(first, last, strict=True)) == [(0, 1), (1, 2), (2, 4), (4, 6), (6, 7)]
    # "na" (3, 4) ends with "ana" (2, 4); a gram that begins with n may be left out for one from an a before it.
    assert (first - reach).tolist() == [0, 0, 0, 0, 0]


def _strings(padded):
    return [padded[i : i + q] for q in range(2, variants.LONGEST + 1) for i in range(len(padded) - q + 1)]


def _texts():
    rng = random.Random(5)
    words = _made("abcé", 60, 8, rng)
    long = "abcdefgh" * 9
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=300)) for _ in range(12)]
    texts += [" ".join([long[:-1], long[:64], long[:63], long, long[:30] + "z" + long[31:]]) + " "] * 4
    texts += [None, "", "12 - 34", "ABCDEÉ abcdeÉ AbcdeÉ", "zzzzz " * 3, "x" * 5000 + " " + "x" * 5001, "x" * 5000, "x" * 5000, "x" * 5001, "x" * 5001]
    return [(i, t, "k", None, "r") for i, t in enumerate(texts)]


def test_variants(spark):
    rows = _texts()
    rows = [*rows, rows[0], (None, rows[1][1], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = _counts(rows)
    want = _rows(counts)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want) and any(len(r[0]) > 1000 and r[4] for r in want)
    for share in (variants.FREQUENT, 1000):
        out = variants.spelling_variants(variants.word_counts(df.repartition(5)), share=share)
        assert out.columns == COLUMNS
        assert sorted(tuple(r) for r in out.collect()) == want
    assert variants.spelling_variants(variants.word_counts(df.limit(0))).count() == 0


def test_variants_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in variants.op11_variants(spark, SF).collect())
    assert got == _rows(_counts(docs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(variants.ORACLE_OP11).fetchall())


def test_no_join_is_broadcast(spark):
    """The words' small file says nothing of the size of their lists, which would fill the driver."""
    words = session.saved(spark.createDataFrame([(w, 3 + i) for i, w in enumerate(_made("abcdef", 50, 8, random.Random(1)))], "word string, n long"))
    for df in (variants.near_words(words), variants.spelling_variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
