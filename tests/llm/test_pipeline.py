"""The pipeline against a brute-force version on tables made here."""

import random
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexhoard.llm import pii


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [a + b for a in ("ta", "re", "mo", "li", "ka") for b in ("ver", "sto", "nel", "dia", "rup", "fen")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, toxic = [], set()
    for i in range(600):
        text = prose(80)
        if i % 6 == 0:
            text += " you idiot"
            toxic.add(i)
        docs.append((i, text))
    item = prose(14)
    docs += [(1000, docs[1][1]), (1001, docs[2][1] + " tail"), (1002, docs[3][1].upper()), (1003, f"{prose(20)} {item.upper()}. {prose(20)}"), (1004, f"write a.b@c.org or 10.1.2.3 {prose(30)}"), (1005, None), (1006, ""), (1006, ""), (1007, prose(5000))]
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, toxic, item


def test_stages(spark, made):
    at, docs, toxic, item = made
    left = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.saved(stage(spark, left, at))
        seen[name] = left
        if name != "packing":
            assert left.columns == corpus_pipeline.COLUMNS
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].select("doc_id").collect())
    clean = sorted(i for i, _ in docs if i not in toxic)
    assert ids("toxicity") == clean
    groups = defaultdict(list)
    for i, t in docs:
        if i not in toxic:
            words = tuple(re.findall(r"\S+", (t or "").lower()))
            groups[words[:80] if words else i].append(i)
    assert ids("near_duplicates") == sorted(min(g) for g in groups.values())
    assert ids("decontamination") == [i for i in ids("near_duplicates") if i != 1003]
    masked = {r["doc_id"]: r for r in seen["pii"].collect()}
    for i, t in docs:
        if i in masked:
            assert masked[i]["text"] == (pii.masked(t) if t else t) and masked[i]["n_chars"] == (None if t is None else len(masked[i]["text"]))
    assert masked[1004]["text"].startswith("write [EMAIL] or [IP] ")
    packed = defaultdict(int)
    for r in seen["packing"].collect():
        packed[r["doc_id"]] += r["n_words"]
    assert dict(packed) == {i: len(re.findall(r"\S+", r["text"] or "")) for i, r in masked.items()}


def test_run_and_entry(spark, made):
    out = corpus_pipeline.run(spark, made[0]).collect()
    assert len({r["bin"] for r in out}) > 1 and max(r["bin_offset"] + r["n_words"] for r in out) <= 2048
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
