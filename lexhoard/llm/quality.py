"""Quality rules: a linear-chain conditional random field over the lines of a text.

Each line gets features of its characters and its place; Viterbi decoding marks it content or boilerplate; the share of characters
in content lines decides whether the text is kept. The field is trained in numpy by gradient ascent on the likelihood
(forward-backward), on windows of lines from a bounded sample of labelled documents. Labels are of documents, and a field that
saw each document alone would learn that lines of a text never differ. So half of the training sequences join a window of a
good document to one of a bad document, each line with its own document's label: there the gold path changes state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import agreed, arrow_sized, documents, held_out
from lexhoard.session import table

#: Labelled documents that the field is fitted on, at most (as an expected number of a hash sample).
MAX_LABELLED = 2000
#: Lines in a window, and windows of a document, at most, that the field learns from: they bound what reaches the driver.
LINES, WINDOWS = 12, 3
#: Characters of a text in content lines, as a share, below which it isn't kept.
MIN_CONTENT = 0.5
MIN_WORDS = 50

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
N_FEATURES = 10


def counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = data.split()
    chars = sum(map(len, words)) - len(data) + len(data.decode())  # continuation bytes are never white space
    lines, seen, dup = data.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    return len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) < 2_000_000:
        m = len(number)
        windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        _, inverse, n = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        _, inverse, n = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = n[inverse.reshape(-1)] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= twice
    return int(covered.sum())


def line_features(data: bytes) -> tuple[np.ndarray, list[int]]:
    """One row of features per line with a word, and the line's length."""
    rows, sizes, seen = [], [], set()
    for line in data.split(b"\n"):
        n = len(line)
        words = len(line.split())
        if not words:
            continue
        upper = n - len(line.translate(None, _UPPER))
        symbols = n - len(line.translate(None, _SYMBOLS))
        digits = n - len(line.translate(None, _DIGITS))
        rows.append((1.0, upper / n, symbols / n, digits / n, line.count(b"!") / n, words < 4, words < 8, line in seen, line.rstrip().endswith(b"."), min(1.0, 5 * line.count(b"|") / n)))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), sizes


def viterbi(scores: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best sequence of states 0 (boilerplate) and 1 (content)."""
    (t00, t01), (t10, t11) = trans.tolist()
    steps = scores.tolist()
    a, b = steps[0]
    back = []
    for x, y in steps[1:]:
        from_a, from_b = a + t00 >= b + t10, a + t01 > b + t11
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = x + (a + t00 if from_a else b + t10), y + (a + t01 if from_b else b + t11)
    at = int(b >= a)
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return out[::-1]


def windows(data: bytes) -> list[np.ndarray]:
    """Features of at most WINDOWS runs of at most LINES lines, spread evenly over the text."""
    features, _ = line_features(data)
    n = -(-len(features) // LINES)
    return [features[i * LINES : (i + 1) * LINES] for i in sorted({j * n // WINDOWS for j in range(min(WINDOWS, n) or 0)} if n > WINDOWS else range(n))]


def train_field(rows: list[tuple[np.ndarray, int]], epochs: int = 120, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2), from (window, label of its document). Without windows of both labels: all
    lines are content."""
    weights, trans = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    of = [[f for f, y in rows if y == c and len(f)] for c in (0, 1)]
    if not all(of):
        weights[0, 1] = 1
        return weights, trans
    alone = [(f, np.full(len(f), c)) for c in (0, 1) for f in of[c]]
    joined = []
    for i in range(max(map(len, of))):  # every window stands in a joined sequence, in either place by turns
        parts = [(of[c][i % len(of[c])], c) for c in ((0, 1) if i % 2 else (1, 0))]
        joined.append((np.concatenate([f for f, _ in parts]), np.concatenate([np.full(len(f), c) for f, c in parts])))
    lines = alone + joined
    share = np.array([len(of[c]) for c in (0, 1)]) / len(alone)
    weight = np.concatenate([0.5 / share[[y[0] for _, y in alone]] / len(alone), np.full(len(joined), 1 / len(joined))])
    longest = 2 * LINES
    x = np.zeros((len(lines), longest, N_FEATURES))
    gold = np.zeros((len(lines), longest, 2))
    there = np.zeros((len(lines), longest), bool)
    gold_pairs = np.zeros((2, 2))
    each = weight * len(lines) / 2 / np.array([len(f) for f, _ in lines])  # labels, and alone and joined ones, weigh the same
    for i, (f, y) in enumerate(lines):
        x[i, : len(f)], there[i, : len(f)] = f, True
        gold[i, np.arange(len(f)), y] = each[i]
        np.add.at(gold_pairs, (y[:-1], y[1:]), each[i])
    first, second = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2))], [np.zeros((N_FEATURES, 2)), np.zeros((2, 2))]
    for epoch in range(1, epochs + 1):
        scores = x @ weights
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(there[:, t, None], scores[:, t] + np.logaddexp(forward[:, t - 1, :1] + trans[0], forward[:, t - 1, 1:] + trans[1]), forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = scores[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(there[:, t + 1, None], np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1]), 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        belief = np.exp(forward + backward - total[:, None, None]) * there[..., None] * each[:, None, None]
        pairs = np.exp(forward[:, :-1, :, None] + trans + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]) * (there[:, 1:] * each[:, None])[..., None, None]
        grads = [np.einsum("itf,itc->fc", x, gold - belief) - 0.02 * weights, gold_pairs - pairs.sum((0, 1)) - 0.02 * trans]
        for i, (p, g) in enumerate(zip((weights, trans), grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p += rate * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-9)
    return weights, trans


def _windows(batches):
    for batch in batches:
        found = [(y, w.ravel().tolist()) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for w in windows(t)]
        yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([w for _, w in found], pa.list_(pa.float64()))], ["quality", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Fits the field on a hash sample of about max_labelled labelled documents, held-out ones left aside. A doc_id that labels
    hold with both qualities counts as unlabelled."""
    known = agreed(labels, "quality").where(~held_out())
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, max_labelled / max(1, n))))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select(F.col("quality").cast("int"), "text")
    rows = sample.mapInArrow(_windows, "quality int, features array<double>").orderBy("quality", "features").collect()  # bounded by max_labelled, LINES and WINDOWS
    return train_field([(np.array(r["features"]).reshape(-1, N_FEATURES), r["quality"]) for r in rows])


def _judge(weights, trans):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share"]

    def judge(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                features, sizes = line_features(data)
                states = viterbi(features @ weights, trans) if sizes else []
                share = sum(n for n, s in zip(sizes, states, strict=True) if s) / sum(sizes) if sizes else 0.0
                out.append((*counts(data), share))
            columns = [pa.array([x[i] for x in out], pa.int64() if i < 5 else pa.float64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return judge


def score_quality(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, content_share, base_failed, kept): one row per input row.

    Null and empty texts have no words, share 0, and fail. kept is false if base_failed, else content_share >= MIN_CONTENT.
    """
    arrow_sized(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.mapInArrow(_judge(*field), schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= MIN_CONTENT))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`, with the field fitted on `labels.quality`; one column more: content_share."""
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
