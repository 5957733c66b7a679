"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments, forwards and backwards, and labels every position with language
probabilities; a document's probabilities are the mean over all its positions. It is trained here, in numpy, by
backpropagation through time, on a bounded sample of labelled rows that are not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import arrow_sized, documents, held_out

#: Rows of each language that are learned from, at most (as an expected number of a hash sample).
MAX_PER_LANGUAGE = 300
#: Units of each direction, bytes in a segment, segments that go through the network together.
UNITS, SEGMENT, TOGETHER = 8, 64, 2048
STEPS, BATCH = 160, 160


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _init(rng, n_classes: int) -> dict[str, np.ndarray]:
    p = {"c": np.zeros(n_classes)}
    for d in "fb":
        p |= {f"x{d}": rng.normal(0, 0.3, (256, 3 * UNITS)), f"u{d}": rng.normal(0, 0.3, (UNITS, 3 * UNITS)), f"v{d}": rng.normal(0, 0.3, (UNITS, n_classes))}
    return p


def _loss_gradients(p: dict, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
    n, steps = x.shape
    h_units = UNITS
    kept = {}
    logits = np.tile(p["c"], (n, steps, 1))
    for d in "fb":
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        h, trace = np.zeros((n, h_units)), {}
        for t in order:
            a, hu = p[f"x{d}"][x[:, t]], h @ p[f"u{d}"]
            z, r = _sigmoid(a[:, :h_units] + hu[:, :h_units]), _sigmoid(a[:, h_units : 2 * h_units] + hu[:, h_units : 2 * h_units])
            new = np.tanh(a[:, 2 * h_units :] + r * hu[:, 2 * h_units :])
            m = there[:, t, None]
            trace[t] = (h, z, r, new, hu[:, 2 * h_units :], m)
            h = ((1 - z) * new + z * h) * m
            logits[:, t] += h @ p[f"v{d}"]
            kept[d, t] = h
        kept[d] = (list(order), trace)
    logits -= logits.max(2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(2, keepdims=True)
    total = there.sum()
    loss = -(np.log(prob[np.arange(n), :, y] + 1e-12) * there).sum() / total
    delta = prob.copy()
    delta[np.arange(n), :, y] -= 1
    delta *= there[..., None] / total
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"] = delta.sum((0, 1))
    for d in "fb":
        order, trace = kept[d]
        back = np.zeros((n, h_units))
        for t in reversed(order):
            h, z, r, new, un, m = trace[t]
            g[f"v{d}"] += kept[d, t].T @ delta[:, t]
            back = (back + delta[:, t] @ p[f"v{d}"].T) * m
            dz = back * (h - new) * z * (1 - z)
            dn = back * (1 - z) * (1 - new * new)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(g[f"x{d}"], x[:, t], da)
            g[f"u{d}"] += h.T @ dhu
            back = back * z + dhu @ p[f"u{d}"].T
    return loss, g


def train_network(rows: list[tuple[bytes, int]], n_classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on batches of random segments, each language as often as the others."""
    rng = np.random.default_rng(seed)
    p = _init(rng, n_classes)
    of = [[t for t, y in rows if y == c] for c in range(n_classes)]
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, there = np.zeros((BATCH, SEGMENT), np.uint8), np.zeros((BATCH, SEGMENT), bool)
        y = rng.integers(0, n_classes, BATCH)
        for i, c in enumerate(y):
            text = of[c][rng.integers(len(of[c]))]
            n = SEGMENT if rng.random() < 0.7 else int(rng.integers(8, SEGMENT))
            at = int(rng.integers(max(1, len(text) - n + 1)))
            piece = np.frombuffer(text[at : at + n], np.uint8)
            x[i, : len(piece)], there[i, : len(piece)] = piece, True
        _, g = _loss_gradients(p, x, there, y)
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return p


def _ready(p: dict) -> dict:
    """Single precision, units before segments, gates scaled so that a sigmoid is one tanh."""
    out = {k: np.ascontiguousarray(v.T, np.float32) for k, v in p.items()}
    for d in "fb":
        out[f"x{d}"][: 2 * UNITS] *= 0.5
        out[f"u{d}"][: 2 * UNITS] *= 0.5
    return out


def _segment_sums(p: dict, x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Sum of the position probabilities of each segment (classes x segments). x and there are steps x segments."""
    steps, n = x.shape
    logits = np.empty((steps, len(p["c"]), n), np.float32)
    logits[:] = p["c"][:, None]
    a, hu, new = (np.empty((k * UNITS, n), np.float32) for k in (3, 3, 1))
    for d in "fb":
        h = np.zeros((UNITS, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(p[f"x{d}"], x[t], axis=1, out=a, mode="clip")
            np.matmul(p[f"u{d}"], h, out=hu)
            gates = a[: 2 * UNITS]
            gates += hu[: 2 * UNITS]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.multiply(hu[2 * UNITS :], gates[UNITS:], out=new)
            new += a[2 * UNITS :]
            np.tanh(new, out=new)
            h -= new
            h *= gates[:UNITS]
            h += new
            h *= there[t]
            logits[t] += p[f"v{d}"] @ h
    np.exp(np.minimum(logits, 60, out=logits), out=logits)
    logits *= (there / logits.sum(1))[:, None]
    return logits.sum(0)


def document_probabilities(p: dict, texts: list[bytes]) -> np.ndarray:
    """Mean of the position probabilities of each text; zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + b"\0" * SEGMENT, np.uint8)
    n_segments = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), n_segments)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    start = np.repeat(np.cumsum(sizes) - sizes, n_segments) + number * SEGMENT
    left = np.repeat(sizes, n_segments) - number * SEGMENT
    total = np.zeros((len(texts), len(p["c"])))
    for i in range(0, len(doc), TOGETHER):
        at = start[i : i + TOGETHER] + np.arange(SEGMENT)[:, None]
        there = np.arange(SEGMENT)[:, None] < left[i : i + TOGETHER]
        np.add.at(total, doc[i : i + TOGETHER], _segment_sums(p, data[at], there.astype(np.float32)).T)
    return total / np.maximum(sizes, 1)[:, None]


def fit_language(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, steps: int = STEPS) -> tuple[dict, list[str]] | None:
    """Network and language names, from a hash sample of about max_per_language rows of each language. None without any."""
    known = docs.where("lang is not null and octet_length(text) > 0").where(~held_out()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(1e6 * min(1.0, max_per_language / n)) + 1)])
    some = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")])
    rows = some.orderBy("doc_id", "text").select("text", "lang").collect()  # bounded by max_per_language
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    return _ready(train_network([(r["text"].encode(), langs.index(r["lang"])) for r in rows], len(langs), steps)), langs


def identify_language(docs: DataFrame, model: tuple[dict, list[str]] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per input row. `und` with score 0 for texts that are null or have no letter, and for
    all texts without a model."""
    arrow_sized(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def predict(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            if use:
                prob = document_probabilities(model[0], [texts[i].encode() for i in use])
                for i, row in zip(use, prob, strict=True):
                    names[i], scores[i] = model[1][int(row.argmax())], float(min(1.0, row.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`, learned from the lang of those that are not held out."""
    docs = documents(spark, sf_dir)
    return identify_language(docs, fit_language(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
