"""Each operator against brute force or an invariant, on small tables with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lexhoard.llm import decontaminate, jaccard, language, licenses, packing, pii, quality, sharding, suffixes, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, cls string, words int"


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _texts():
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "délta", "the", "of", "ЖУК", "x9"]
    prose = lambda n: " ".join(rng.choice(words) + (rng.choice([".", "\n", ""]) if rng.random() < 0.1 else "") for _ in range(n))
    base = [prose(rng.randint(1, 150)) for _ in range(24)]
    near = [t + " one more word" for t in base[:6]]
    shared = prose(90)
    return [None, "", " \n ", "ok", *base, *base[:5], *near, f"{prose(30)} {shared} {prose(20)}", f"{prose(10)} {shared}", prose(9000)]


def _rows(texts):
    return [(i, t, "en", "s0" if i % 3 else None, None, 1, "x", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = _rows(_texts())
    return spark.createDataFrame([*rows, rows[10], (None, "null id text", "de", "s1", 1, 1, "x", 2)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(spark, empty):
    texts = [None, "", "Released under the MIT License.", "UNDER THE MIT-LICENSE under the mit license", "apache license, version 2.0; CC BY-NC", "under mit the license", "under the mıt license", "under the MIT licensé",
             "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "cc by nc cc by nc cc by nc"]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = licenses.scan_licenses(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        words = WORD.findall(_lower(texts[r["doc_id"]]))
        assert r["n_words"] == len(words)
        want = sorted((label, i) for label, phrase in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p)
        assert sorted((s["label"], s["first_word"]) for s in r["spans"] if s["base"]) == want
    assert [s["label"] for r in out if r["doc_id"] == 8 for s in r["spans"]] == ["mit"]
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_verify_spans(spark):
    notice = dict(licenses.NOTICES)
    fragment = " ".join(notice["mpl-2"].split()[:8])
    texts = [(notice[x], [x]) for x in notice] + [
        ("x y " + notice["gpl"].replace("public license", "public new license") + " z", ["gpl"]),
        (" a ".join([fragment] * 12), []),
        (" ".join(" ".join(notice["bsd"].split()[i : i + 6]) for i in (18, 12, 6, 0)), []),
        (notice["cc-by"] + " and " + notice["lgpl"], ["cc-by", "lgpl"]),
        ("this is free of charge for any purpose this is free of charge for any", []),
    ]
    out = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    for r in out:
        assert sorted(s["label"] for s in r["spans"] if not s["base"]) == texts[r["doc_id"]][1], texts[r["doc_id"]][0]


def test_sharding(docs, empty):
    for n in (16, 3):
        out = sharding.shard_documents(docs, n).collect()
        assert len(out) == docs.count()
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(slots[s]) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_keeps_copies_together(spark):
    rows = [(i, f"text {i % 40}" if i < 160 else f"alone {i}") for i in range(480)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    spread = defaultdict(set)
    for r in out:
        if r["doc_id"] < 160:
            spread[r["doc_id"] % 40].add(r["shard"])
    assert sum(len(v) == 1 for v in spread.values()) >= 38


def test_decontamination(spark, docs, empty):
    texts = [r["text"] for r in docs.collect()]
    words = WORD.findall(_lower(texts[12]))
    items = [(1, " ".join(words[3:20]) if len(words) > 20 else texts[12]), (2, "OK"), (3, None), (4, "..."), (15, "x9 of the"), (2, "gamma of"), (None, "délta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for item, t in items:
        w = WORD.findall(_lower(t))
        windows |= {(tuple(w[i : i + 10]), item and str(item)) for i in range(max(1, len(w) - 9) if w else 0)}
    for block in (decontaminate.BLOCK_BYTES, 20):
        for r in decontaminate.find_benchmark(docs, bench, block_bytes=block).collect():
            w = WORD.findall(_lower(r["text"]))
            hit, ids = set(), set()
            for window, item in windows:
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        ids.add(item)
            assert r["bench_words"] == len(w) and r["bench_items"] == sorted(ids - {None})
            got = [i for s in r["bench_spans"] for i in range(s["word_from"], s["word_to"])]
            assert sorted(got) == sorted(hit)
            for s in r["bench_spans"]:
                assert WORD.findall(_lower(r["text"][s["char_from"] : s["char_to"]])) == w[s["word_from"] : s["word_to"]]
    assert decontaminate.find_benchmark(empty, bench).count() == 0
    assert decontaminate.find_benchmark(docs, bench.limit(0)).where("size(bench_items) > 0").count() == 0
    with pytest.raises(ValueError, match="bench_Items"):
        decontaminate.find_benchmark(docs.withColumn("bench_Items", docs.text), bench)


def test_decontamination_in_blocks_equals_one_block(spark):
    """Clashing column names, repeated and null rows, several items hit in one text."""
    rows = [(i, None if i % 7 == 0 else f"w{i % 5} alpha beta gamma délta w{i % 3} é", i % 2, "x") for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, words string")
    bench = spark.createDataFrame([(i, f"{w} {i % 3}") for i, w in enumerate(["alpha beta", "gamma délta w1", "w2 É", "é"])] + [(9, "beta gamma"), (10, "délta W2"), (11, "Alpha"), (None, "w4")], "item_id long, text string")
    one, several = (Counter(map(str, decontaminate.find_benchmark(docs, bench, block_bytes=b).collect())) for b in (10**6, 15))
    assert one == several and any("10" in r and "11" in r for r in one)


_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_pii(text):
    out = []
    for kind, pattern in _KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), list(_KINDS).index(kind), m.end()))
    return sorted(out)


def test_pii_base_equals_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "@", "a@b", ".", "x.y@z-w.co.uk", "1.2.3.4", "999.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "+1 2 3", "7", " ", "-", "%", "é", "+44 20 7946 0958."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 8)))
        assert pii.find_identifiers(text) == _plain_pii(text), text


def test_pii_disguises_map_back():
    for text, want in [
        ("write to john (at) mail [dot] com now", "john (at) mail [dot] com"),
        ("write to john at mail dot example dot com now", "john at mail dot example dot com"),
        ("call plus one seven four three five five five three eight two four ok", "plus one seven four three five five five three eight two four"),
        ("jоhn@mаil.com", "jоhn@mаil.com"),
        ("ip １.2.３.4 end", "１.2.３.4"),
    ]:
        assert [text[s["start"] : s["end"]] for s in pii._spans(text)] == [want], text
    for clean in ["the cat sat at the dot on the map", "one two three", "we met at noon", "", "élan vital"]:
        assert pii._spans(clean) == []
    assert pii.masked("a@b.c and 1.2.3.4") == "[EMAIL] and [IP]"


def test_pii_fragments_and_mixed_disguises():
    text = "x jоhn@mail.com y"
    assert [(text[s["start"] : s["end"]], s["base"]) for s in pii._spans(text)] == [("jоhn@mail.com", False), ("hn@mail.com", True)]
    assert pii.masked(text) == "x [EMAIL] y"
    for text, want in [
        ("to john (at) mail dot com now", "john (at) mail dot com"),
        ("to john at mail (dot) xyz now", "john at mail (dot) xyz"),
        ("to john[at]mail.example.museum now", "john[at]mail.example.museum"),
        ("to john@mail dot museum", "john@mail dot museum"),
        ("to john at mail.com now", "john at mail.com"),
        ("to john at mail dot co dot uk now", "john at mail dot co dot uk"),
        ("jоhn (at) mail dot com", "jоhn (at) mail dot com"),
        ("call plus 1 seven four 3 555 three eight 2 four ok", "plus 1 seven four 3 555 three eight 2 four"),
        ("host 10 dot 1 dot 2 [dot] 3 up", "10 dot 1 dot 2 [dot] 3"),
    ]:
        assert [text[s["start"] : s["end"]] for s in pii._spans(text) if not s["base"]] == [want], text
    for clean in ["seen at www.example.org now", "one of 1234567 at noon. Then", "rows 1, 2, 3, 4, 5, 6, 7, 8"]:
        assert pii._spans(clean) == []


def test_pii_table(docs, empty):
    assert pii.find_pii(docs).count() == docs.count()
    assert pii.mask_pii(docs).where("text is null").count() == 1
    assert pii.find_pii(empty).count() == 0
    pii.find_identifiers("+1" + "(" * 200_000 + "a" * 200_000 + "@" * 1000)  # linear


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == _components(rows)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_two_hubs(spark):
    """Texts linked to two others that are not linked: in groups of two, the second hub's link must count as well."""
    rows, want = [], []
    for c in range(300):
        words = [f"w{c}x{i}" for i in range(8)]
        texts = {3 * c: words[:7], 3 * c + 1: words, 3 * c + 2: words[1:]}
        sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in texts.items()}
        near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
        assert near(3 * c, 3 * c + 1) and near(3 * c + 1, 3 * c + 2) and not near(3 * c, 3 * c + 2)
        rows += [(i, " ".join(w)) for i, w in texts.items()]
        want += [(i, 3 * c) for i in texts]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == want


@pytest.mark.parametrize(("together", "spread"), [(4000, 500), (12, 5), (1, 1)])
def test_jaccard_families(spark, monkeypatch, together, spread):
    """Many variants near the threshold, whose links only partly run over one hub."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    monkeypatch.setattr(jaccard, "SPREAD", spread)
    rng = random.Random(5)
    rows = []
    for i in range(140):
        if i % 70 == 0:
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words[: 60 - i % 7])))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == _components(rows)


def _numbers(sigs_of, n):
    sigs, of = sigs_of
    return [set(sigs[of == i].tolist()) for i in range(n)]


def test_partenum_shares_a_signature():
    import numpy as np

    rng = np.random.default_rng(2)
    pairs = []
    for n in [1, 2, 3, 4, 5, 7, 8, 12, 13, 30, 41, 60, 100, 300, 1000, 3000] * 40:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        lost, new = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 3 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        if jaccard.linked(a, b):
            pairs += [a, b]
    assert len(pairs) > 600
    for share in (0, 0.3, 0.9, 1):
        hot = np.sort(np.concatenate([rng.permutation(a)[: int(len(a) * share)] for a in pairs[::2]]))
        for batch in (pairs, pairs[::-1]):
            found = _numbers(jaccard.signatures(batch, jaccard.Frequent(hot)), len(batch))
            assert all(x & y for x, y in zip(found[::2], found[1::2], strict=True))


def test_sketches_never_pass_over_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 400, 5000):
        a, b = (np.unique(rng.integers(0, 2**63, m, dtype=np.uint64)) for m in (n, n // 3))
        b = np.unique(np.concatenate([a[n // 5 :], b]))
        sketches = [jaccard.sketch(x) for x in (a, b)]
        assert 0 < jaccard.differences(sketches, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, b)) or n == 1
        assert jaccard.differences(sketches, np.array([0]), np.array([0]))[0] == 0


@pytest.mark.parametrize("length", [40, 100])
def test_suffixes(docs, empty, length):
    rows = docs.select("doc_id", "text").collect()
    out = suffixes.remove_repeats(docs, length).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out)
    assert got == Counter((r["doc_id"], *x) for r, x in zip(rows, suffixes.brute_force([r["text"] for r in rows], length), strict=True))
    if length == 100:
        assert suffixes.remove_repeats(empty, length).count() == 0


def _passages(texts, passage):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + passage]) for w in words for i in range(len(w) - passage + 1))
    covered = [{j for i in range(len(w) - passage + 1) if seen[tuple(w[i : i + passage])] > 1 for j in range(i, i + passage)} for w in words]
    return [len(x) for x in covered]


def test_suffixes_query_against_brute_force(spark, tmp_path):
    """The registered query at 400 bytes and 51 words, with passages on both sides of both limits."""
    rng = random.Random(12)
    words = ["alpha", "be", "gamma", "délta", "the", "of", "ЖУК", "x9", "superlative"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    parts = [prose(n) for n in (50, 51, 52, 60, 75, 90, 140)] + ["z" * 399, "y" * 400, "w" * 401]
    texts = [None, "", *(f"{prose(rng.randint(0, 60))} {rng.choice(parts)} {prose(rng.randint(0, 60))} {rng.choice(parts)}" for _ in range(60))]
    texts += texts[5:8]
    spark.createDataFrame(_rows(texts), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in suffixes.op6_suffixes(spark, str(tmp_path)).collect()}
    for i, (want, words_in) in enumerate(zip(suffixes.brute_force(texts), _passages(texts, 51), strict=True)):
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept_sha256"]) == want
        assert out[i]["n_passage_words"] == words_in


def test_suffixes_with_a_hot_line(spark):
    rng = random.Random(4)
    line = "this very common line of text stands in nearly all of the documents of the table, word by word. "
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(120) + line + noise(100) + ("tail " * 30 if i % 9 == 0 else "")) for i in range(150)]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    want = dict(zip((i for i, _ in rows), suffixes.brute_force([t for _, t in rows], 80), strict=True))
    assert {r["doc_id"]: (r["n_removed"], len(r["spans"])) for r in out} == {k: v[1:3] for k, v in want.items()}


@pytest.mark.parametrize("unit", [1, 4])
def test_suffixes_buckets_against_brute_force(unit):
    """Positions of one and of four bytes: minimizers of joined texts, and buckets that agree, split or meet a context's end."""
    import numpy as np

    rng = random.Random(unit)
    length, gram = 70, suffixes.GRAM // unit
    parts = [bytes(rng.choices(b"ab", k=unit * rng.randint(20, 200))) for _ in range(6)]
    texts = [b"".join(rng.choices(parts, k=rng.randint(3, 5))) for _ in range(30)]
    texts = [t for t in texts if len(t) >= length * unit]
    sizes = np.array([len(t) // unit for t in texts])
    ends, data = np.cumsum(sizes), b"".join(texts)
    windows = [[t[i * unit : (i + length) * unit] for i in range(len(t) // unit - length + 1)] for t in texts]
    seen = Counter(w for ws in windows for w in ws)
    want = [seen[w] > 1 for ws in windows for w in [*ws, *[None] * (length - 1)]]
    assert suffixes.refine(data, np.repeat(ends, sizes), length, unit).tolist() == want
    hashes = suffixes.gram_hashes(data, unit)
    at, first, last = suffixes.owned(hashes, np.array([], np.uint64), ends - sizes, sizes, length, gram, 0)
    told = {i: a for a, b, c in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(b, c)}
    starts = [e - n + i for e, n, ws in zip(ends.tolist(), sizes.tolist(), windows, strict=True) for i in range(len(ws))]
    assert told == {i: i + int(np.argmin(hashes[i : i + length - gram + 1] >> np.uint64(32))) for i in starts}


def test_suffixes_reads_texts_once_for_both_searches(spark, docs, monkeypatch):
    """Frequent grams, contexts, cutting, refinement, packing and removal: one pass each, not one a search."""
    from pyspark.sql.classic.dataframe import DataFrame

    calls, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **kw: (calls.append(1), real(self, *a, **kw))[1])
    suffixes.remove_repeats(docs)
    assert len(calls) == 6


def test_quality_counts():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é\t", "\n", "c# ", " ", "|", "a b c "]) for _ in range(rng.randint(0, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
        lines, dup = text.split("\n"), 0
        for i, line in enumerate(lines):
            dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        assert quality.counts(text.encode()) == want, text


def test_quality_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in range(1, 8):
        scores, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731, RUF007
        assert value(quality.viterbi(scores, trans)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))


def test_quality_table(spark, docs, empty):
    good, bad = b"A fine line of words.\nAnother one, with more words.", b"BUY!! NOW!! $$$ ### %%%\nBUY!! NOW!! $$$ ###"
    field = quality.train_field([(w, y) for text, y in [(good, 1), (bad, 0)] * 20 for w in quality.windows(text)])
    out = {r["doc_id"]: r for r in quality.score_quality(docs, field).collect()}
    assert not out[0]["kept"] and not out[1]["kept"] and out[0]["n_words"] == 0
    states = lambda text: quality.viterbi(quality.line_features(text)[0] @ field[0], field[1])
    assert states(bad) == [0, 0] and states(good) == [1, 1]
    assert states(good + b"\n" + bad) == [1, 1, 0, 0] and states(bad + b"\n" + good) == [0, 0, 1, 1]
    assert quality.score_quality(empty, field).count() == 0
    long = quality.windows(b"one line of words\n" * 200_000)
    assert len(long) == quality.WINDOWS and all(len(w) == quality.LINES for w in long) and quality.windows(b"\n") == []
    assert [len(w) for w in quality.windows(b"a b\n" * 30)] == [12, 12, 6]
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 1, 0), (5, 1, 1), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["quality"] for r in quality.agreed(labels, "quality").collect()} == {5: 1}
    assert quality.fit_quality(docs, labels)[0][0, 1] == 1 and quality.fit_quality(empty, labels)[0][0, 1] == 1


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(8)
    words = ["the", "and", "river", "stone", "walking", "letter", "number", "sister", "under"]
    rows = []
    for i in range(900):
        text = " ".join(rng.choice(words) for _ in range(40))
        toxic = i % 5 == 0
        rows.append((i, text + (" you idiot and moron " if toxic else ""), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(10**6, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    return toxicity.fit_toxicity(docs, labels)


def test_toxicity(spark, docs, toxic_model):
    trigrams, floor, *_ = toxic_model
    for token, plain in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("m0r0n", "moron"), ("m o r o n", "moron")]:
        assert toxicity.decode(token, trigrams, floor) == plain
    texts = ["the river", "you idiot", "you 1d10t there", "an i d i o t walks", "a moooron", None, "", "letter 42 and number 7", "IDIOT!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = [r["toxicity"] for r in toxicity.score_toxicity(rows, toxic_model).orderBy("doc_id").collect()]
    assert [s >= toxicity.THRESHOLD for s in scores] == [False, True, True, True, True, False, False, False, True]
    assert toxicity.score_toxicity(docs, toxic_model).count() == docs.count()


@pytest.mark.parametrize(
    "text", ["l053r", "a l0$3r!", "idio7", "idi07", "(idi07)", "iddiot", "i d 1 0 t", "i-d-1-0-t", "a i d i o t", "m o r o n i d i o t", "you-are-idi0t", "$tupid", "i  d  i  o  t", "x" * 70 + "." + "y.z" * 30 + "-1d10t"]
)
def test_toxicity_reads_every_disguise(spark, text):
    words = ["the", "and", "a", "river", "stone", "walking", "letter", "number", "sister", "under", "aid"]
    rng = random.Random(8)
    rows = [" ".join(rng.choice(words) for _ in range(40)) + (" you idiot and moron stupid loser " if i % 5 == 0 else "") for i in range(900)]
    if not hasattr(test_toxicity_reads_every_disguise, "model"):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
        test_toxicity_reads_every_disguise.model = toxicity.fit_toxicity(docs, labels)
    trigrams, floor, weights, _, _, bonus = test_toxicity_reads_every_disguise.model
    assert toxicity._signal(f"the river {text} walking", toxicity._Reader(trigrams, floor, bonus), weights) > 0
    for clean in ["a letter and a b c", "well-known 3rd of 1999", "you!!", "THE!!"]:
        assert "idiot" not in toxicity.restore(clean, toxicity._Reader(trigrams, floor, bonus))


def test_toxicity_reads_letters_alone_as_the_lattice_does(toxic_model):
    trigrams, floor, weights, _, _, bonus = toxic_model
    read, rng = toxicity._Reader(trigrams, floor, bonus), random.Random(14)
    for _ in range(400):
        token = "".join(c * rng.choice([1, 1, 2, 3]) for c in rng.choice(["idiot", "moron", "letter", "stone", "idito", "Ærer"]))
        plain = [w for _, _, t in toxicity.readings(token, read) for w in toxicity._words(t)]
        want = max((weights[w] for w in {*plain, *toxicity._words(token.lower())} if w in weights), default=0.0)
        assert toxicity._signal(token.lower(), read, weights) == want, token


def test_toxicity_counts_letters_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PENDING", 50)
    texts = ["the river", "Señor zyzz", None, "ЖУК x9 zyzz"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    trigrams, *_ = toxicity.fit_toxicity(docs, labels)
    read = [texts[r["doc_id"]] for r in docs.where(~toxicity.held_out()).collect()]
    want = defaultdict(int)
    for w in " ".join(t.lower() for t in read if t).split():
        if w in ("the", "river", "señor", "zyzz"):
            for i in range(len(w) + 1):
                want[f"^^{w}^"[i : i + 3]] += 1
    assert set(trigrams) == set(want)
    starts = sum(n for g, n in want.items() if g[:2] == "^^")
    assert trigrams["^^z"] == pytest.approx(math.log((want["^^z"] + 0.01) / (starts + 0.01 * (len(toxicity.ALPHABET) + 1))))


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, none)
    assert toxicity.score_toxicity(docs, model).where("toxicity >= 0.3").count() == 0


def test_language_gradients(monkeypatch):
    import numpy as np

    monkeypatch.setattr(language, "UNITS", 3)
    rng = np.random.default_rng(0)
    p, x, y = language._init(rng, 3), rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    there = np.ones((4, 6), bool)
    there[1, 4:] = False
    _, g = language._loss_gradients(p, x, there, y)
    for k in ("uf", "ub", "vf", "vb", "xf", "xb", "c"):
        at = (int(x[0, 2]), 1) if k[0] == "x" else (1, 2) if k != "c" else (1,)
        p[k][at] += 1e-5
        up = language._loss_gradients(p, x, there, y)[0]
        p[k][at] -= 2e-5
        down = language._loss_gradients(p, x, there, y)[0]
        p[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=1e-4, abs=1e-9)


def test_language(spark, empty):
    rng = random.Random(2)
    of = {"en": ["the", "and", "with", "shop"], "de": ["der", "und", "nicht", "schön"], "fr": ["le", "et", "avec", "été"]}
    rows = [(i, " ".join(rng.choice(of[lang]) for _ in range(40)), lang) for i in range(300) for lang in [rng.choice(list(of))]]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60)
    tests = [(i, " ".join(rng.choice(of[lang]) for _ in range(30)), lang) for i in range(60) for lang in [rng.choice(list(of))]]
    tests += [(100, None, "und"), (101, "", "und"), (102, "123 !", "und"), (103, "½ ² Ⅷ", "und")]
    out = {r["doc_id"]: r for r in language.identify_language(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert sum(out[i]["lang_pred"] == lang for i, _, lang in tests) >= 62
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language.fit_language(empty) is None
    assert language.identify_language(spark.createDataFrame(tests, "doc_id long, text string, lang string"), None).where("lang_pred <> 'und'").count() == 0


def test_packing(docs, empty):
    out = packing.pack_documents(docs, 100, 2).collect()
    rows = docs.collect()
    placed, held = Counter(), defaultdict(list)
    text = {r["doc_id"]: r for r in rows}
    for r in out:
        placed[r["doc_id"]] += r["n_words"]
        held[r["bin"]].append(r)
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert placed == want or {k: v for k, v in placed.items() if v} == {k: v for k, v in want.items() if v}
    of_source = Counter(text[p["doc_id"]]["source"] for p in out if p["n_words"])
    limit = {s: max(2, math.ceil(packing.EVEN_SHARE * n / -(-sum(want.values()) // 100))) for s, n in of_source.items()}
    for pieces in held.values():
        assert sum(p["n_words"] for p in pieces) <= 100
        assert all(n <= limit[s] for s, n in Counter(text[p["doc_id"]]["source"] for p in pieces if p["n_words"]).items())
        assert max(Counter(text[p["doc_id"]]["text"] for p in pieces if p["n_words"]).values(), default=0) <= 1
        at = 0
        for p in sorted(pieces, key=lambda p: (p["bin_offset"], -p["n_words"])):
            assert p["bin_offset"] >= at or p["n_words"] == 0
            at = p["bin_offset"] + p["n_words"]
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_one_source_and_of_empty_texts():
    bins, _ = packing.pack_block([100] * 10_000, ["a"] * 10_000, list(range(10_000)), 2048, 2)
    assert max(bins) + 1 == 500  # 20 texts of 100 words fill a sequence of 2048
    bins, _ = packing.pack_block([0] * 1000, [None] * 1000, [7] * 1000, 2048, 2)
    assert set(bins) == {0}


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(9)
    for _ in range(50):
        n = rng.randint(1, 60)
        sizes, sources, clusters = ([rng.randint(0, 40) for _ in range(n)], [rng.choice("abc") for _ in range(n)], [rng.randint(0, n) for _ in range(n)])
        bins, _ = packing.pack_block(sizes, sources, clusters, 50, 2)
        full = max(1, -(-sum(sizes) // 50))
        limit = {s: max(2, math.ceil(packing.EVEN_SHARE * sum(x == s and m > 0 for x, m in zip(sources, sizes, strict=True)) / full)) for s in "abc"}
        state = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            fits = []
            for k, b in enumerate(state):
                room = 50 - sum(sizes[j] for j in b)
                closed = room == 0 or all(sum(sources[j] == s and sizes[j] > 0 for j in b) >= limit[s] for s in set(sources))
                clash = sizes[i] > 0 and (sum(sources[j] == sources[i] and sizes[j] > 0 for j in b) >= limit[sources[i]] or any(clusters[j] == clusters[i] and sizes[j] > 0 for j in b))
                if room >= sizes[i] and not closed and not clash:
                    fits.append((room, k))
            k = min(fits)[1] if fits else len(state)
            if not fits:
                state.append([])
            state[k].append(i)
            assert bins[i] == k
