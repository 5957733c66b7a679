"""Removal of repeated byte strings by bucket-pointer refinement (Schuermann and Stoye, 2007) of windows.

Every window of LENGTH bytes that starts at two places is to go. Sorting all suffixes of a corpus would shuffle it many times
over, so windows are first grouped by content: the window's minimizer, the smallest hash of its GRAM-byte grams, is the same
wherever the window stands. Windows that one minimizer place owns form a context (their common bytes). Contexts whose bytes
occur twice are repeated as a whole; other contexts of a shared minimizer are compared: their positions are put in buckets by
their first GRAM bytes, and the buckets are refined by the bucket numbers of later offsets, the numbers of each round serving the
next (32, 64, ... 256, LENGTH bytes), all buckets of a level at a time. A bucket of one is final; one whose members agree at the
later offset is not sorted.

Grams that very many documents share never decide for a group while a window has others, so that a common line does not bring
all its documents together. Contexts that are equal count once. No group gathers more than distinct contexts of one minimizer.

The same passes take word codes beside the bytes, of four bytes a position, and so find passages of PASSAGE words that stand
elsewhere too; LENGTH bytes may be more than such a passage has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.llm.base import arrow_sized, documents, keyed
from lexhoard.session import discard, saved

LENGTH = 400
#: Words of the shortest passage that counts as repeated, whatever its bytes.
PASSAGE = 51
GRAM = 32
#: Only grams with a hash below this share of the range are counted: the minimum of a window's grams lies above it about once in 10**5.
COUNTED = 0.03
#: Grams that more than this share of the documents hold are frequent. Since a document of n bytes has n * COUNTED counted grams,
#: their number is at most (mean bytes of a document) * COUNTED / HOT_SHARE, whatever the size of the table.
HOT_SHARE = 1 / 1000
#: Bytes of contexts that are refined together: few enough to be sorted in a processor's cache.
CHUNK = 400_000

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C[0]
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: bytes, unit: int = 1) -> np.ndarray:
    """Hash of the GRAM bytes from each position; positions are `unit` bytes apart."""
    step = 8 // unit
    eight = np.ndarray((len(data) // unit - step + 1,), "<u8", data, strides=(unit,))
    h = _mix(eight * _C[1])
    h = h[:-step] * _C[2] + h[step:]
    h = h[: -2 * step] * _C[3] + h[2 * step :]
    return _mix(h)


def _is_hot(hashes: np.ndarray, hot: np.ndarray, tag: int) -> np.ndarray:
    """Places of frequent grams; `hot` is sorted, its numbers are tagged hashes."""
    low = np.flatnonzero(hashes < np.uint64(int(COUNTED * 2**64)))
    told = _tagged(hashes[low], tag)
    return low[hot[np.minimum(np.searchsorted(hot, told), len(hot) - 1)] == told]


def _tagged(hashes: np.ndarray, tag: int) -> np.ndarray:
    """Hashes with the number of a search as highest bit; so as longs those of the first are at least 0, of the second less."""
    return (hashes & np.uint64(2**63 - 1)) | np.uint64(tag << 63)


def owned(hashes: np.ndarray, hot: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer position, first window, one past the last) for runs of windows with one minimizer, in texts that stand one
    behind the other, each with a window at least."""
    w = length - gram + 1
    code = hashes >> np.uint64(1)
    if len(hot):
        code[_is_hot(hashes, hot, tag)] |= np.uint64(1 << 63)
    # Of ranks that are equal in their upper half the first counts, wherever the window stands.
    code &= np.uint64(2**64 - 2**31)
    code |= np.arange(len(code), dtype=np.uint64)
    n, span = len(code) - w + 1, 1
    while 2 * span <= w:
        code = np.minimum(code[:-span], code[span:])
        span *= 2
    code = np.minimum(code[:n], code[w - span : w - span + n])
    edge = np.zeros(n + 1, np.int8)
    edge[starts] = 1
    edge[starts + sizes - length + 1] -= 1
    inside = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
    at = (code[inside] & np.uint64(2**31 - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], inside[first], inside[last] + 1


def refine(data: bytes, ends: np.ndarray, length: int, unit: int = 1) -> np.ndarray:
    """For each position (they are `unit` bytes apart) whether the `length` positions from it, which must end by `ends`, also
    start at another one.

    Positions are sorted into buckets once, by their first GRAM bytes. A pass reads each member's bucket at a later offset;
    buckets whose members agree there stay as they are, and only the others are sorted."""
    n, q = len(data) // unit, GRAM // unit
    room = (ends - np.arange(n)).astype(np.int32)
    at = np.flatnonzero(room >= q)
    if not len(at):
        return np.zeros(n, bool)
    values = gram_hashes(data, unit)
    bits = np.uint64(n.bit_length())
    order = np.sort(((values[at] >> bits) << bits) | at.astype(np.uint64))
    high = order >> bits
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key = values[order]
    new = key[1:] != key[:-1]
    if np.any(new & (high[1:] == high[:-1])):  # hashes that differ in their lower bits only
        order = at[np.argsort(values[at], kind="stable")]
        key = values[order]
        new = key[1:] != key[:-1]
    while True:
        new = np.concatenate([[True], new, [True]])
        several = ~(new[1:] & new[:-1])  # a bucket of one is final
        order = order[several]
        number = np.cumsum(new[:-1], dtype=np.int32)[several]
        bucket = np.zeros(n, np.int32)
        bucket[order] = number
        if q == length or not len(order):
            return bucket > 0
        step = min(q, length - q)
        far = np.flatnonzero(room[order] >= q + step)
        order, number = order[far], number[far]
        later = bucket[order + step]
        far = np.flatnonzero(later)
        order, number, later = order[far], number[far], later[far]
        if not len(order):
            return np.zeros(n, bool)
        same = number[1:] == number[:-1]
        split = np.zeros(int(number[-1]) + 1, bool)
        split[number[1:][same & (later[1:] != later[:-1])]] = True
        mixed = np.flatnonzero(split[number])
        if len(mixed):
            sort = mixed[np.argsort((number[mixed].astype(np.int64) << 32) | later[mixed], kind="stable")]
            order[mixed], later[mixed] = order[sort], later[sort]
        new = ~same | (later[1:] != later[:-1])
        q += step


def as_bytes(texts: list[bytes | None]) -> list[bytes]:
    return [t or b"" for t in texts]


#: A number for each byte, a factor and its inverse modulo 2 ** 64: a word's hash is the sum of its bytes' numbers, each times the
#: factor to the power of its place, so that sums over a whole text give the hashes of all its words.
_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _C[1]) * _C[2])
_FACTOR, _INVERSE = np.uint64(0xA0761D6478BD642F), np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_BLANK = np.array([bytes([x]).isspace() for x in range(256)])
#: Bytes of texts that are coded and hashed together.
CODED = 100_000


def as_words(texts: list[bytes | None]) -> list[bytes]:
    """Four bytes a word (a run without white space): its hash, so that equal runs of words are equal strings."""
    out, group, size = [], [], 0
    for text in texts:
        group.append(text or b"")
        size += len(group[-1])
        if size > CODED:
            out += _coded(group)
            group, size = [], 0
    return out + _coded(group)


def _coded(texts: list[bytes]) -> list[bytes]:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = np.concatenate([[True], _BLANK[data]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    power, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)])
    shift = inverse[starts]
    hashes = _mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64) * _C[3])
    codes = (_mix(hashes * _C[2]) >> np.uint64(32)).astype("<u4")
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    return [codes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _powers(n: int, held: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of the factor and of its inverse, kept for the next call."""
    if not held or len(held[0]) < n:
        held[:] = (np.cumprod(np.full(2 * n, x, np.uint64)) for x in (_FACTOR, _INVERSE))
    return held[0][:n], held[1][:n]


def _joined(texts: list[bytes], length: int, unit: int):
    """Texts with a window at least, some at a time: (their numbers, their bytes together, starts and sizes in positions)."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= length * unit:
            group.append(i)
            size += len(text)
        if group and (size > CODED or i == len(texts) - 1):
            sizes = np.array([len(texts[j]) // unit for j in group])
            yield np.array(group), b"".join([texts[j] for j in group]), np.cumsum(sizes) - sizes, sizes
            group, size = [], 0


def _frequent(searches):
    def count(batches):
        held, n_held, docs = [], 0, 0

        def told():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(3, HOT_SHARE * docs)
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

        for batch in batches:
            raw = batch.column(0).cast(pa.binary()).to_pylist()
            for tag, (length, unit, encode) in enumerate(searches):
                for _, data, starts, sizes in _joined(encode(raw), length, unit):
                    hashes = gram_hashes(data, unit)
                    low = np.flatnonzero(hashes < np.uint64(int(COUNTED * 2**64)))
                    text = np.searchsorted(starts, low, "right") - 1
                    inside = low + GRAM // unit <= (starts + sizes)[text]
                    h, text = _tagged(hashes[low[inside]], tag), text[inside]
                    order = np.lexsort((h, text))
                    h, text = h[order], text[order]
                    held.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)]])
                    n_held += len(held[-1])
            docs += len(raw)
            if n_held > 2_000_000:
                yield told()
                held, n_held, docs = [], 0, 0
        if held:
            yield told()

    return count


def _contexts(hot: np.ndarray, searches):
    def find(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            keys, raw = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            for tag, (length, unit, encode) in enumerate(searches):
                for numbers, data, starts, sizes in _joined(encode(raw), length, unit):
                    hashes = gram_hashes(data, unit)
                    at, first, last = owned(hashes, hot, starts, sizes, length, GRAM // unit, tag)
                    text = np.searchsorted(starts, first, "right") - 1
                    rows[0].append(keys[numbers[text]])
                    rows[1].append(_tagged(hashes[at], tag).view(np.int64))
                    ranges = zip((first * unit).tolist(), ((last + length - 1) * unit).tolist(), strict=True)
                    rows[2].append(np.fromiter((xxhash.xxh64_intdigest(data[a:b]) - (1 << 63) for a, b in ranges), np.int64, len(at)))
                    rows[3].append(first - starts[text])
                    rows[4].append(last - first)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(rows, (np.int64,) * 3 + (np.int32,) * 2, strict=True)], ["k", "a", "c", "start", "n"])

    return find


def _packed(batches):
    """Texts as they are shuffled: packed in half the space that the shuffle's own compression takes."""
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t and pack(t) for t in texts], pa.binary())], ["doc_id", "k", "text"])


def _cut(searches):
    def cut(batches):
        for batch in batches:
            keys, rows, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [zstandard.decompress(x) for x in batch.column(1).to_pylist()]
            out = []
            for tag, (length, unit, encode) in enumerate(searches):
                for k, t, xs in zip(keys, encode(texts), rows, strict=True):
                    out += [(x["a"], x["c"], k, x["start"], x["whole"], t[x["start"] * unit : (x["start"] + x["n"] + length - 1) * unit]) for x in xs if (x["a"] < 0) == tag]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["a", "c", "k", "start", "whole", "context"])

    return cut


def _refined(searches):
    """From contexts sorted by minimizer: the windows of each that also stand elsewhere, as ranges in its text. Those of contexts
    that are repeated as a whole are not told."""

    def judge(group):
        length, unit, _ = searches[group[0][0] < 0]
        sizes = np.array([len(x[5]) // unit for x in group])
        ends = np.cumsum(sizes)
        twice = refine(b"".join([x[5] for x in group]), np.repeat(ends, sizes), length, unit)
        # No window starts at the last position of a context, so ranges end within it.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.view(np.int8), [0]])))
        lo, hi = edge[::2], edge[1::2] - 1
        which = np.searchsorted(ends, lo, "right")
        keys, starts, whole, tags = (np.array([x[i] for x in group]) for i in (2, 3, 4, 0))
        told = ~whole[which]
        lo, hi, which = lo[told], hi[told], which[told]
        moved = starts[which] - (ends - sizes)[which]
        return pa.RecordBatch.from_arrays([pa.array(keys[which]), pa.array((tags[which] < 0).astype(np.int32)), pa.array((lo + moved).astype(np.int32)), pa.array((hi + moved).astype(np.int32))], ["k", "search", "lo", "hi"])

    def run(batches):
        group, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[-1][0] and (size > CHUNK or (row[0] < 0) != (group[-1][0] < 0)):
                    yield judge(group)
                    group, size = [], 0
                # Rows with equal doc_id and text are one text here, and cut twice; equal contexts of one place count once.
                if not group or row[:2] != group[-1][:2]:
                    group.append(row)
                    size += len(row[5])
        if group:
            yield judge(group)

    return run


def _merged(ranges, length: int) -> list[list[int]]:
    """Maximal runs [from, to) that windows with starts in the ranges cover."""
    runs = []
    for a, b in sorted(ranges):
        b += length
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return runs


def _removed(length: int, passage: int):
    def remove(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, told = zstandard.decompress(text) if text else b"", ([], [])
                for x in ranges or ():
                    told[x["search"]].append((x["lo"], x["hi"]))
                runs = _merged(told[0], length)
                kept, last = [], 0
                for a, b in runs:
                    kept.append(text[last:a])
                    last = b
                kept = b"".join([*kept, text[last:]])
                out.append((len(text), len(text) - len(kept), [{"from": a, "to": b} for a, b in runs], kept, sum(b - a for a, b in _merged(told[1], passage))))
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_passage_words"])

    return remove


def _repeated(rows: DataFrame, packed: DataFrame, searches) -> DataFrame:
    """Saved (k, ranges): for texts with windows that start at two places, ranges of their starts, by the number of the search
    (length, bytes of a position, encoding of texts), which is also the highest bit of its minimizers; `packed` are the same rows
    with packed text."""
    n = rows.count()
    often = rows.select("text").mapInArrow(_frequent(searches), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(64.0, HOT_SHARE * n))
    hot = np.sort(np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64))  # bounded, see HOT_SHARE

    places = saved(rows.select("k", "text").mapInArrow(_contexts(hot, searches), "k long, a long, c long, start int, n int"))
    # The first values of a group are all one row's.
    contexts = places.groupBy("a", "c").agg(F.count("*").alias("times"), *(F.first(x).alias(x) for x in ("k", "start", "n")))
    contexts = contexts.withColumn("m", F.count("*").over(Window.partitionBy("a"))).where("m > 1 or times > 1")
    contexts = saved(contexts.select("a", "c", "k", "start", "n", (F.col("times") > 1).alias("whole"), (F.col("m") > 1).alias("shared")))
    ones = contexts.where("shared").groupBy("k").agg(F.collect_list(F.struct("a", "c", "start", "n", "whole")).alias("wanted"))
    cut = packed.join(ones, "k").select("k", "text", "wanted").mapInArrow(_cut(searches), "a long, c long, k long, start int, whole boolean, context binary")
    within = cut.repartition("a").sortWithinPartitions("a", "c").mapInArrow(_refined(searches), "k long, search int, lo int, hi int")
    whole = places.join(contexts.where("whole").select("a", "c"), ["a", "c"], "left_semi")
    whole = whole.select("k", (F.col("a") < 0).cast("int").alias("search"), F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))
    out = saved(within.union(whole).groupBy("k").agg(F.collect_set(F.struct("search", "lo", "hi")).alias("ranges")))
    discard(places, contexts)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, n_passage_words): one row per input row; spans are the maximal removed runs of
    bytes, kept the remaining bytes, n_passage_words the words in strings of `passage` words that start at another place too
    (which are not removed for that). Null and empty texts have no bytes. Strings are judged on the input, repeated rows like any
    copies, and matches never cross texts. `length` is at least GRAM, and 4 * `passage` too."""
    arrow_sized(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    packed = rows.select("doc_id", "k", "text").mapInArrow(_packed, f"doc_id {id_type}, k long, text binary")
    ranges = _repeated(rows, packed, ((length, 1, as_bytes), (passage, 4, as_words)))
    left = packed.join(ranges, "k", "left").select("doc_id", "text", "ranges")
    return left.mapInArrow(_removed(length, passage), f"doc_id {id_type}, n_bytes long, n_removed long, spans array<struct<from:int,to:int>>, kept binary, n_passage_words long")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`; one column more: n_passage_words."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """For tests: n_bytes, n_removed, n_spans and kept_sha256 of each text, by listing all windows."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(b for b, x in zip(d, gone, strict=True) if not x)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
