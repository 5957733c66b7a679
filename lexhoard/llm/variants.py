"""Spelling variants of words, by an index of variable-length grams.

Grams of the words, with marks at both ends, are counted; those that occur more often than a share of the words are frequent. The
dictionary holds the grams that aren't frequent while all that they begin with are. A word's grams are, from each place, the gram of
the dictionary that starts there, without those that end where an earlier one ends. For each place of a word it follows which of its
grams an edit there can affect; all others are grams of the edited word too. So near words agree, for the place of their
difference, in the nearest gram that it can't affect on either side, and, as one edit is all there is, in what lies beyond. The
index's lists of both are merged by joining on both at once, and pairs are verified. A place where an edit can affect all grams of
the word has the rest of the word instead, so no near word is lost.

Joins here ask for a merge, so that none is broadcast: Spark sizes the lists, with their dozens of rows a word, by the words' file,
which is small and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import LOWER, UPPER, crc32_sql, documents
from lexhoard.session import discard, saved

#: Code points of a word and occurrences that it must have, and times that a form must occur more often than the word.
MIN_LENGTH, MIN_COUNT, TIMES = 5, 3, 2
#: One run in DROP_EVERY loses a letter.
DROP_EVERY = 97
#: A gram is frequent if it occurs more often than once in so many words. At most 7 * FREQUENT * (mean length + 2) grams are.
FREQUENT = 16
#: Codes in a gram at most: 7 bits each and a leading one fit in 64.
LONGEST = 8
#: Longer words are indexed by the rest of the word for all places, and by number, as they have too many places to list the word at each.
LONG = 64
_FIRST, _LAST = 126, 127
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of A-Z, a-z and \\u00C0-\\u00FF, A-Z lower-cased, one of DROP_EVERY (by the hash of id and run) without the
    letter that the hash points to, of at least min_length code points and min_count occurrences. Null texts have no words; a null
    id hashes as no text at all."""
    run = F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % DROP_EVERY == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 128 of all words, each between _FIRST and _LAST, and where each word starts."""
    points = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.select([points == 1, points == 2, points >= 0xC0], [_FIRST, _LAST, points - 0xC0 + 32], points - 97 + 1), np.flatnonzero(points == 1)


def _room(n: int, starts: np.ndarray) -> np.ndarray:
    """Codes from each place to the end of its word."""
    ends = np.append(starts[1:], n)
    return np.repeat(ends, ends - starts) - np.arange(n)


def all_grams(words: list[str]) -> np.ndarray:
    """Every gram of 2 to LONGEST codes of the words, packed: a leading one bit, then 7 bits a code."""
    codes, starts = _codes(words)
    room, value, out = _room(len(codes), starts), codes + 128, []
    for q in range(2, LONGEST + 1):
        at = np.flatnonzero(room >= q)
        value[at] = value[at] << 7 | codes[at + q - 1]
        out.append(value[at])
    return np.concatenate(out)


def without_first(grams: np.ndarray) -> np.ndarray:
    """Sorted packed grams without their first codes."""
    width = np.floor(np.log2(grams.astype(np.float64))).astype(np.int64) // 7 if len(grams) else grams
    below = np.int64(1) << (7 * (width - 1))
    return np.unique(grams % below + below)


def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def decompose(codes: np.ndarray, starts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, reach) of every gram of the words, as places in `codes`. frequent: the packed frequent grams, sorted.

    Whatever begins with a gram that isn't frequent isn't either, so ends grow with places. The gram from p to e is found from
    codes p to e alone, and left out only for one from p - 1 that ends at e too, which asks for a frequent gram of one code and then
    p to e - 1. Where there is such a gram, reach is p - 1, else p: a change of a code, or its loss, affects the gram if the code
    lies in reach to e, and a code put in before place i affects it if i lies in reach + 1 to e.
    """
    n = len(codes)
    room, value = _room(n, starts), codes + 128
    end, live = np.full(n, -1), np.arange(n)
    for q in range(2, LONGEST + 1):
        live = live[room[live] >= q]
        value[live] = value[live] << 7 | codes[live + q - 1]
        hot = _in(frequent, value[live])
        end[live[~hot]] = live[~hot] + q - 1
        live = live[hot]
    first = np.flatnonzero((end >= 0) & (end != np.append(-1, end[:-1])))
    return first, end[first], first - _in(without_first(frequent), value[first] >> 7)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def index_keys(words: list[str], frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, check): for each place of each word, once, a hash of what a word that differs there has in common with it by its
    grams. `frequent` None: the whole rest of the word, for all places; then words are near if key and check agree."""
    codes, starts = _codes(words)
    n, ends = len(codes), np.append(starts[1:], len(codes))
    place = np.arange(n)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    first, last, reach = decompose(codes, starts, frequent) if frequent is not None else (np.zeros(0, np.int64),) * 3

    def nearest(at: np.ndarray, there: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Grams numbered `at`, -1 where there are none in the place's word."""
        good = (at >= 0) & (at < len(of))
        good[good] &= word[of[at[good]]] == word[there][good]
        return np.where(good, at, -1)

    # A code changed or lost at i lies between the marks; one put in before i may also be the last one.
    edit, gap = place[(place > starts[word]) & (place < ends[word] - 1)], place[place > starts[word]]
    there = np.concatenate([edit, gap])
    rest = np.concatenate([edit + 1, gap])  # where the rest of the word begins
    left = nearest(np.searchsorted(last, there, "left") - 1, there, first)
    right = nearest(np.concatenate([np.searchsorted(reach, edit, "right"), np.searchsorted(reach, gap, "left")]), there, first)
    bare = (left < 0) & (right < 0)
    take = lambda of, at, otherwise: np.where(at >= 0, of[np.maximum(at, 0)], otherwise) if len(of) else np.full(len(at), otherwise)
    upto = np.where(bare, there, take(last, left, -1) + 1)  # the common beginning ends before it; 0: none
    since = np.where(bare, rest, take(first, right, n))  # the common end starts there; n: none

    keys = []
    with np.errstate(over="ignore"):
        from_start, from_end = place - starts[word], ends[word] - 1 - place
        for base in _BASES:
            power = np.cumprod(np.full(int((ends - starts).max()) if n else 1, base, np.uint64))
            value = (codes + 1).astype(np.uint64)
            head = np.append(np.uint64(0), np.cumsum(value * power[from_start]))
            tail = np.append(np.uint64(0), np.cumsum(value * power[from_end]))
            begins = np.where(upto > 0, head[upto] - head[starts[word[there]]], np.uint64(0))
            closes = np.where(since < n, tail[ends[word[there]]] - tail[np.minimum(since, n)], np.uint64(0))
            keys.append(_mixed(_mixed(begins) + np.uint64(3) * _mixed(closes + np.uint64(1)) + bare.astype(np.uint64)).view(np.int64))
    rows = np.unique(np.stack([word[there], *keys]), axis=1) if n else np.zeros((3, 0), np.int64)
    return rows[0], rows[1], rows[2]


def frequent_grams(words: DataFrame, share: int = FREQUENT) -> np.ndarray:
    """The packed grams that occur more often than once in `share` of the words (word), sorted. They are few, whatever the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                grams, counts = np.unique(all_grams(b.column(0).to_pylist()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    n = words.count()
    counts = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["gram"] for r in counts.where(F.col("n") * share > n).collect()), np.int64)


def near_words(words: DataFrame, share: int = FREQUENT) -> DataFrame:
    """(word, n, other, n_other) of every two words (word, n) that differ by one code point put in, lost or replaced, in both
    orders. Words are distinct and made of a-z and \\u00C0-\\u00FF."""
    spark = words.sparkSession
    short, long = words.where(F.length("word") <= LONG), words.where(F.length("word") >= LONG)
    frequent = spark.sparkContext.broadcast(frequent_grams(short, share))

    def indexed(by_gram: bool):
        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in range(0, b.num_rows, 2000 if by_gram else 20):
                    rows = b.slice(part, 2000 if by_gram else 20)
                    word, key, check = index_keys(rows.column(0).to_pylist(), frequent.value if by_gram else None)
                    if by_gram:
                        yield pa.RecordBatch.from_arrays([pa.array(key), *[rows.column(i).take(pa.array(word)) for i in (0, 1)]], names=["key", "word", "n"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), rows.column(2).take(pa.array(word))], names=["key", "check", "id"])

        return index

    lists = short.select("word", "n").mapInArrow(indexed(True), "key long, word string, n long")
    l, r = lists.alias("l"), lists.alias("r").hint("merge")
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.word") < F.col("r.word")) & (F.levenshtein("l.word", "r.word", 1) == 1))
    pairs = met.select(F.struct("l.word", "l.n").alias("a"), F.struct("r.word", "r.n").alias("b"))
    # Long words by number; the hash of all that is left is the proof.
    numbered = saved(long.withColumn("id", F.xxhash64("word")))
    places = numbered.select("word", "n", "id").mapInArrow(indexed(False), "key long, check long, id long")
    l, r = places.alias("l"), places.alias("r").hint("merge")
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.check") == F.col("r.check")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    of = lambda c: numbered.select(F.col("id").alias(c), F.struct("word", "n").alias(f"_{c}")).hint("merge")
    longer = met.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where(f"greatest(length(a.word), length(b.word)) > {LONG}")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.distinct().unionByName(longer).select(both.alias("p")).select("p.a.word", "p.a.n", F.col("p.b.word").alias("other"), F.col("p.b.n").alias("n_other"))


def spelling_variants(words: DataFrame, times: int = TIMES, share: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    The form is the near word of largest n (of equal ones the smallest in code-point order) if that is at least `times` the word's
    own n, else null; the root is the last of the forms from the word on, the word itself if it has none. An empty table has none.
    """
    best = near_words(words, share).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    named = best.withColumn("form_n", -F.col("best.less"))
    named = saved(named.select("word", "n_near", F.when(F.col("form_n") >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), "form_n")).alias("to")))
    # n at least doubles with each form, so the doubling of steps ends after the logarithm of the logarithm of n rounds.
    roots = saved(named.where("to is not null").select("word", F.col("to.form").alias("root"), F.lit(True).alias("moved")))
    while roots.where("moved").limit(1).count():
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        was, roots = roots, saved(roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(was)
    out = words.join(named.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("to.form_n").alias("form_n"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the words of all `documents`."""
    return spelling_variants(saved(word_counts(documents(spark, sf_dir))))


#: Near words by what is left of them without one letter.
ORACLE_OP11 = f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n, {crc32_sql("(id || ':' || run)")} AS h FROM r GROUP BY id, run),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS n_other FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.rest),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-n_other, other)) AS other, max(n_other) AS n_other FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= {TIMES} * w.n THEN other END AS form, CASE WHEN n_other >= {TIMES} * w.n THEN n_other END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL),
e AS (SELECT g.word, g.at AS root FROM g JOIN f ON f.word = g.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""
