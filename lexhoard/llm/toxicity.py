"""Toxicity by noisy-channel deobfuscation.

A token that may be disguised (a leet character or filler next to a letter, single letters in a row, a doubled letter) becomes a
lattice: each character may stand for several letters, for none or for a word boundary, at a cost of the channel. Viterbi decoding
finds the reading that is most likely under a character trigram model, with markers as known words. The words of the text as it is
and as restored that mark toxic texts give its score.
The model counts all documents and the scorer learns from labelled rows, without those that are held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import NOT_WORD, WORDS_OF, agreed, arrow_sized, documents, held_out
from lexhoard.session import saved, table

#: Labelled rows that are learned from, at most (as an expected number of a hash sample).
MAX_LABELLED = 30_000
#: A marker is in at least this share of toxic sample texts, and this many times more often than in clean ones.
MIN_SHARE, MIN_RATIO = 0.004, 4.0
#: Log-likelihood ratio (Dunning's G2) from which a word counts as a marker and not as chance.
MIN_G2 = 16.0
THRESHOLD = 0.3

#: Letters a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "*": "aeiou"}
#: Costs (log probabilities) of a substitution, of dropping a repeated letter, of dropping a filler or end punctuation, of a
#: word boundary where a filler stands, and of dropping a letter-like sign at an end.
SUBSTITUTE, REPEAT, FILLER, BOUNDARY, SIGN = -1.0, -0.5, -0.2, -0.2, -3.0
#: Log odds that a disguised word is a marker rather than any other word, as markers are what is worth a disguise.
DISGUISED = 3.0
_FILL = " ._*-"

_leet = re.escape("".join(c for c in LEET if c != "*"))
_LETTER = r"[^\W\d_]"
#: What makes a token suspect: a run of single letters and leet characters, a leet character or filler next to a letter, or a doubled letter.
_RUN = rf"(?<![\w{_leet}])(?:{_LETTER}|[{_leet}])(?:[\s._*-]{{1,3}}(?:{_LETTER}|[{_leet}])){{2,}}(?![\w{_leet}])"
RUN = re.compile(_RUN)
SUSPECT = re.compile(
    rf"(?P<run>{_RUN})|{_LETTER}[{_leet}*]|[{_leet}*]{_LETTER}|{_LETTER}[._*-]+[\w{_leet}]|[{_leet}][._*-]+{_LETTER}|({_LETTER})\2",
    re.IGNORECASE,
)
_REST = re.compile(r"\S*")
_HAS_LETTER = re.compile(_LETTER)
#: Punctuation at the ends of a token that stands for no letter.
_PUNCTUATION = ".,;:?\"'()[]{}<>%&#\u2018\u2019\u201c\u201d\u00ab\u00bb\u00a1\u00bf\u2026"
#: Letters of the character model. No leet character stands for a letter of another script.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_WORD, _PLAIN = re.compile(r"[^\W_]+"), re.compile(f"[{ALPHABET}]+")
#: Characters after which a task sums up the words it has read.
PENDING = 8_000_000
#: Longest token whose reading is remembered; longer ones are read anew each time.
MAX_TOKEN = 60
#: Readings that are remembered.
MAX_READ = 100_000


_DOUBLED = re.compile(r"(.)\1+", re.DOTALL)


def squeezed(word: str) -> str:
    """The word with each letter once where it is repeated."""
    return _DOUBLED.sub(r"\1", word)


def lexicon(bonus: dict[str, float]) -> tuple[dict[str, float], frozenset[str]]:
    """Words with what each is likelier as a word than by its trigrams, and all their beginnings."""
    return bonus, frozenset(w[:i] for w in bonus for i in range(len(w) + 1))


def decode(token: str, model: dict[str, float], floor: float, words: tuple[dict[str, float], frozenset[str]] = ({}, frozenset())) -> str:
    """The most likely plain reading of a disguised token, in time linear in its length. Readings are kept as linked letters."""
    bonus, begun = words
    text = token.lower()
    inner = [i for i, c in enumerate(text) if c.isalnum()]
    first, last = (inner[0], inner[-1]) if inner else (0, -1)
    # A state is the last two letters and the word so far, if a known word begins so.
    best: dict[tuple, tuple] = {("^^", "" if begun else None): (0.0, None)}
    before = ""
    for i, c in enumerate(text):
        ways = [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        if c == before and ways:
            ways.append(("", REPEAT))
        if c in _FILL or c.isspace() or not ways or (c == "!" and i > last):
            ways.append(("", FILLER))
        elif not c.isalnum() and not first < i < last:
            ways.append(("", SIGN))
        now: dict[tuple, tuple] = {}
        for state, (score, out) in best.items():
            two, word = state
            for x, cost in ways:
                if x:
                    longer = None if word is None or word + x not in begun else word + x
                    to, s, path = (two[1] + x, longer), score + cost + model.get(two + x, floor), (out, x)
                else:
                    to, s, path = state, score + cost, out
                if to not in now or s > now[to][0]:
                    now[to] = (s, path)
            if two != "^^" and not c.isalnum():
                to, s = ("^^", "" if begun else None), score + BOUNDARY + model.get(two + "^", floor) + bonus.get(word, 0.0)
                if to not in now or s > now[to][0]:
                    now[to] = (s, (out, " "))
        best, before = now, c
    ends = {state: score + (model.get(state[0] + "^", floor) + bonus.get(state[1], 0.0) if state[0] != "^^" else 0.0) for state, (score, _) in best.items()}
    out, letters = best[max(ends, key=lambda state: (ends[state], state[0]))][1], []
    while out:
        out, x = out
        letters.append(x)
    return "".join(reversed(letters)).strip()


def readings(text: str, read) -> list[tuple[int, int, str]]:
    """(start, end, reading) of the suspect tokens of a text, in order."""
    out, last = [], 0
    for m in SUSPECT.finditer(text):
        if m.start() < last:
            continue
        a, b = m.span()
        if m["run"] is None:
            while a > last and not text[a - 1].isspace():
                a -= 1
            b = _REST.match(text, b).end()
        last = b
        core = text[a:b].strip(_PUNCTUATION)
        if core and _HAS_LETTER.search(core):
            a = text.index(core, a)
            out.append((a, a + len(core), read(core)))
    return out


def restore(text: str, read) -> str:
    """The text with its disguised tokens replaced by their readings."""
    out, last = [], 0
    for a, b, plain in readings(text, read):
        out += [text[last:a], plain]
        last = b
    return "".join(out) + text[last:] if out else text


def _words(text: str) -> list[bytes]:
    """Words in lower case, as the markers are learned, whatever letters they have."""
    return (text if text.isascii() else text.lower()).encode().translate(WORDS_OF).split()


def _signal(text: str | None, read: _Reader, weights: dict[bytes, float]) -> float:
    """Weight of the strongest marker in the text as it is or restored: one insult is enough, however long the text is."""
    if not text:
        return 0.0
    weigh = lambda words: max((weights[w] for w in words if w in weights), default=0.0)
    strongest = weigh(weights.keys() & set(_words(text)))
    for token in set(text.split()):
        if (w := read.weights.get(token)) is None:
            core = token.strip(_PUNCTUATION).lower()
            # Letters alone can only lose repetitions, so no marker is read into a token that isn't one when both are squeezed.
            w = 0.0 if core.isalpha() and squeezed(core) not in read.markers else weigh(_words(" ".join(plain for _, _, plain in readings(token, read))))
            if len(token) <= MAX_TOKEN:
                if len(read.weights) >= MAX_READ:
                    read.weights.clear()
                read.weights[token] = w
        strongest = max(strongest, w)
    for m in RUN.finditer(text):
        strongest = max(strongest, weigh(_words(read(m[0]))))
    return strongest


class _Reader:
    """Reads tokens and remembers short ones, and the weight of the strongest marker in each."""

    def __init__(self, model: dict[str, float], floor: float, bonus: dict[str, float]):
        words = lexicon(bonus)
        self.markers = {squeezed(w) for w in bonus}
        self.long = lambda token: decode(token, model, floor, words)
        self.short = lru_cache(MAX_READ)(self.long)
        self.weights: dict[str, float] = {}

    def __call__(self, token: str) -> str:
        return self.short(token) if len(token) <= MAX_TOKEN else self.long(token)


def _scores(trigrams, floor, weights, slope, bias, bonus, at):
    def score(batches):
        read = _Reader(trigrams, floor, bonus)
        for batch in batches:
            x = [bias + slope * _signal(t, read, weights) for t in batch.column(at).to_pylist()]
            new = pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "toxicity"])

    return score


def _gram_counts(batches):
    """(gram, n): trigrams of the words over ALPHABET, summed within a partition. Words wait until PENDING characters are read."""
    grams: Counter[str] = Counter()
    words: Counter[bytes] = Counter()
    pending = 0

    def count() -> None:
        for said, n in words.items():
            for w in _WORD.findall(said.decode()):
                if _PLAIN.fullmatch(w):
                    padded = f"^^{w}^"
                    for i in range(len(w) + 1):
                        grams[padded[i : i + 3]] += n
        words.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update(_words(text.lower()))
                pending += len(text)
                if pending >= PENDING:
                    count()
                    pending = 0
    count()
    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple:
    """(trigram model, its floor, marker weights, slope, bias, bonus of each marker as a word). Trigrams are counted over all
    documents that are not held out, labelled or not; the rest is learned from a hash sample of labelled rows. A doc_id that
    labels hold with both values counts as unlabelled.

    Word and trigram counts are made in Spark; what reaches the driver is bounded: trigrams by ALPHABET, markers by MIN_SHARE. Without toxic rows every score is the base rate's.
    """
    arrow_sized(docs.sparkSession)
    known = agreed(labels, "toxic").where(~held_out())
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * min(1.0, max_labelled / max(1, n))))
    sample = saved(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id"))  # some is bounded by max_labelled
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    words = sample.select("toxic", F.explode_outer(F.array_distinct(F.array_remove(F.split(F.lower("text"), NOT_WORD), ""))).alias("word"))
    table_ = saved(words.where("word is not null").groupBy("word").agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_clean")))
    ratio = (F.col("in_toxic") + 0.5) / (toxic + 1) / ((F.col("in_clean") + 0.5) / (clean + 1))
    both = F.col("in_toxic") + F.col("in_clean")
    part = lambda n, size: F.when(n > 0, n * F.log(n * (toxic + clean) / (both * float(max(1, size))))).otherwise(0.0)
    g2 = 2 * (part(F.col("in_toxic"), toxic) + part(F.col("in_clean"), clean))
    found = table_.where((g2 >= MIN_G2) & (F.col("in_toxic") >= max(3, MIN_SHARE * toxic)) & (ratio >= MIN_RATIO)).select("word", F.log(ratio).alias("weight"), both.alias("n")).orderBy("word").collect()
    weights = {r["word"].encode(): r["weight"] for r in found}
    grams = docs.where(~held_out()).select("text").mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most (len(ALPHABET) + 1) ** 3
    before: dict[str, int] = {}
    for r in grams:
        before[r["gram"][:2]] = before.get(r["gram"][:2], 0) + r["n"]
    trigrams = {r["gram"]: math.log((r["n"] + 0.01) / (before[r["gram"][:2]] + 0.01 * (len(ALPHABET) + 1))) for r in grams}
    floor = math.log(1e-4)
    total = table_.agg(F.sum(both)).collect()[0][0]
    spelled = lambda w: sum(trigrams.get(f"^^{w}^"[i : i + 3], floor) for i in range(len(w) + 1))
    bonus = {r["word"]: DISGUISED + max(0.0, math.log(r["n"] / total) - spelled(r["word"])) for r in found}

    def signals(batches):
        read = _Reader(trigrams, floor, bonus)
        for batch in batches:
            x = [round(2 * _signal(t, read, weights)) / 2 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["toxic", "x"])

    points = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(signals, "toxic int, x double").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()  # by half points
    slope, bias = _logistic([(r["x"], r["toxic"], r["n"]) for r in points])
    return trigrams, floor, weights, slope, bias, bonus


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and bias of a logistic regression by Newton's method, with a weak prior."""
    slope, bias = 0.0, 0.0
    if not points:
        return 0.0, -5.0
    for _ in range(50):
        g0, g1, h00, h01, h11 = -1e-3 * bias, -1e-2 * (slope - 1), 1e-3, 0.0, 1e-2
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * x))))
            g0, g1, w = g0 + n * (y - p), g1 + n * (y - p) * x, n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        bias, slope = bias + max(-2.0, min(2.0, d0)), slope + max(-2.0, min(2.0, d1))
    return max(slope, 0.0), bias


def score_toxicity(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """docs with a column `toxicity` (0 to 1) added; every row and column stays. Null and empty texts score as texts without
    any marker. A column of that name in docs is an error."""
    if "toxicity" in docs.columns:
        raise ValueError("docs must not have a column named toxicity")
    arrow_sized(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", toxicity double"
    return docs.mapInArrow(_scores(*model, docs.columns.index(text_col)), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`, learned from `labels.toxic` of rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
