"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

A text is the set of its distinct 5-word shingles, as 64-bit hashes. Two sets of Jaccard similarity 3/4 or more differ in at most
(n1 + n2) / 7 elements. Sets are dealt to bands of nearly equal size, and each band has a partitioning of its own: the feature
domain falls into first-level partitions, each of them into PARTS second-level ones. If sets differ in at most k elements, fewer
than R = k // 2 + 1 first-level partitions hold two differences or more. In every other one, PARTS - 1 of the second-level
partitions hold the same elements, so a set enumerates, for a first-level partition, its subsets of PARTS - 1 second-level
ones; the elements of a subset are a signature. A first-level partition is rich if at least two of its second-level ones hold
elements: then no subset is empty. A set signs first-level partitions in a fixed order until R of them were rich. Of those, one
is without two differences, and the partner has come as far or further unless it is the first to end, which turns the
argument round; so similar sets share a signature. Sets that never get R rich ones sign the first elements in a fixed order as
well (n / 4 + 1 of them, of which a partner has one), which covers pairs of two such sets.

Elements found in very many sets have first-level partitions of their own, last in the order, so that common passages bring few sets
together. Equal sets are one class throughout. Classes that share a signature are held against the smallest of them, which joins
large groups of near copies with one comparison each; a class that has several such hubs is held against the closest one, and
against each that has no other class. Groups that still hold several components are compared in units of
bounded size, the members of the largest component against the others only, by parity sketches that never pass over a link. Of
what the sketches leave, a first round lists a forest and a second round, after its links have joined components, whatever is
left between components. Every pair listed is verified on the texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.graph import connected_components, joined_components
from lexhoard.llm.base import LOWERED, arrow_sized, documents, keyed, runs
from lexhoard.session import discard, saved

#: Words in a shingle.
WORDS = 5
#: Second-level partitions of a first-level one; subsets of one less are enumerated.
PARTS = 3
#: Features found in more than this share of the sets come last in the order. At most (features of a set on average) / HOT_SHARE
#: features can be so frequent, whatever the size of the table: that bounds the broadcast list.
HOT_SHARE = 1 / 8000
#: Rows of a list of texts to fetch up to which it is broadcast (16 bytes each); for a longer one Spark chooses.
BROADCAST_ROWS = 1_000_000
#: Members of a group, and of those outside its largest component, that meet in one unit.
TOGETHER = 4000
#: Pairs of one hub that are verified in one place.
SPREAD = 500
#: Features that are signed together, and bytes of sketches that are compared together.
CHUNK, SKETCH_BYTES = 400_000, 16_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_32 = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


_TRUE, _NO_SET = np.array([True]), np.zeros(0, np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes | None], hashes: _WordHash) -> list[np.ndarray]:
    """For each UTF-8 text: sorted distinct hashes of its 5-word shingles; with fewer words, of the whole sequence."""
    words = [t.translate(LOWERED).split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words])
    h = _mixed(np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum())))
    n = max(0, len(h) - WORDS + 1)
    total = np.full(n, WORDS, np.uint64)
    for i in range(WORDS):
        total += h[i : n + i] * _PLACE[i]
    total = _mixed(total)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= WORDS:
            one = np.sort(total[at : at + size - WORDS + 1])
            out.append(one[np.concatenate([_TRUE, one[1:] != one[:-1]])])
        elif size:
            out.append(_mixed(np.array([(h[at : at + size] * _PLACE[:size]).sum() + np.uint64(size)], np.uint64)))
        else:
            out.append(_NO_SET)
        at += size
    return out


def _class(features: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(features.tobytes()) - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def bands(longest: int = 1 << 40) -> list[int]:
    """Smallest size of each band; a set and a partner are in the same or in neighbouring bands."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, -(-out[-1] * 16 // 9)))
    return out


_BANDS = np.array(bands())
#: Rich first-level partitions that a set of a band needs at most, and first-level partitions of the band, a quarter more.
_NEEDED = ((_BANDS[1:] - 1) + 4 * (_BANDS[1:] - 1) // 3) // 7 // 2 + 1
_FIRST_LEVEL = _NEEDED + _NEEDED // 4 + 2


class Frequent:
    """Membership in a sorted list of features, most of the time decided by one look-up in a table."""

    def __init__(self, values: np.ndarray):
        self.values, self.mask = values, np.uint64((1 << 22) - 1)
        self.table = np.zeros(1 << 22, bool)
        self.table[values & self.mask] = True

    def among(self, features: np.ndarray) -> np.ndarray:
        """Flags of the features that are in the list."""
        flags = self.table[features & self.mask]
        maybe = np.flatnonzero(flags)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, features[maybe]), len(self.values) - 1)
            flags[maybe] = self.values[at] == features[maybe]
        return flags


def signatures(sets: list[np.ndarray], frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) for sets that are not empty, each signature of a set at least once."""
    sizes = np.array([len(s) for s in sets])
    band = np.searchsorted(_BANDS, sizes, side="right") - 1
    low = _BANDS[band]
    # A set signs in its own band, and in the one below if a partner may be there.
    below = np.flatnonzero((band > 0) & (-(-3 * sizes // 4) < low))
    job_set = np.concatenate([np.arange(len(sets)), below])
    job_band = np.concatenate([band, band[below] - 1])
    differ = np.concatenate([(sizes + 4 * sizes // 3) // 7, (sizes[below] + low[below] - 1) // 7])
    needed = differ // (PARTS - 1) + 1
    parts = _FIRST_LEVEL[job_band]
    start = np.concatenate([[0], np.cumsum(2 * parts)])  # frequent features have as many partitions, after the others

    features = np.concatenate([*sets, *(sets[i] for i in below)])
    job = np.repeat(np.arange(len(job_set)), sizes[job_set])
    h = _mixed(features + (job_band.astype(np.uint64) + np.uint64(1))[job] * _MIX[0])
    often = frequent.among(features)
    first = ((h >> _32) * parts[job].astype(np.uint64) >> _32).astype(np.int64) + often * parts[job]
    second = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS) >> _32).astype(np.int64)
    cell = (start[job] + first) * PARTS + second
    total = np.zeros(start[-1] * PARTS, np.uint64)
    np.add.at(total, cell, h)  # the elements of a second-level partition, in any order
    filled = np.zeros(start[-1] * PARTS, bool)
    filled[cell] = True
    held = filled.reshape(-1, PARTS).sum(1)
    total = total.reshape(-1, PARTS)

    rich = held >= 2
    so_far = np.concatenate([[0], np.cumsum(rich)])
    job_at = np.repeat(np.arange(len(parts)), 2 * parts)
    signed = (held > 0) & (so_far[:-1] - so_far[start[:-1]][job_at] < needed[job_at])
    whole = total.sum(1)
    several, one = np.flatnonzero(signed & rich), np.flatnonzero(signed & ~rich)
    sigs = [whole[several] - total[several, i] for i in range(PARTS)] + [whole[one]]
    of = [job_set[job_at[several]]] * PARTS + [job_set[job_at[one]]]

    short = np.unique(job_set[so_far[start[1:]] - so_far[start[:-1]] < needed])
    for i in short.tolist():
        key = _mixed(sets[i]) >> np.uint64(1)
        key[frequent.among(sets[i])] |= np.uint64(1 << 63)
        key.sort()
        sigs.append(key[: len(key) - -(-3 * len(key) // 4) + 1])
        of.append(np.full(len(sigs[-1]), i))
    return _mixed(np.concatenate(sigs)), np.concatenate(of)


def sketch(features: np.ndarray) -> bytes:
    """Parities of the numbers of elements in at least twice as many cells. Two sets differ in at least as many elements as parities."""
    cells = max(64, 1 << (2 * len(features) - 1).bit_length()) if len(features) else 64
    counts = np.bincount((features >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of `size` bytes or more as rows of that size; halves of a longer one fall together."""
    out = np.empty((len(sketches), size), np.uint8)
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        rows = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint8).reshape(len(at), -1, size)
        out[at] = np.bitwise_xor.reduce(rows, 1)
    return out.view(np.uint64)


def differences(sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of places in a list of sketches: elements in which the sets differ, at least."""
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    shorter = np.minimum(lengths[left], lengths[right])
    out = np.zeros(len(left), np.int64)
    for size in np.unique(shorter).tolist():
        pairs = np.flatnonzero(shorter == size)
        used, place = np.unique(np.concatenate([left[pairs], right[pairs]]), return_inverse=True)
        rows = _folded([sketches[i] for i in used.tolist()], size)
        a, b = place[: len(pairs)], place[len(pairs) :]
        step = max(1, SKETCH_BYTES // size)
        for i in range(0, len(pairs), step):
            out[pairs[i : i + step]] = np.bitwise_count(rows[a[i : i + step]] ^ rows[b[i : i + step]]).sum(1, dtype=np.int64)
    return out


def _sets(batches):
    """Per text: its class and size. After each run of texts: a row of size -1 per feature that is frequent in the run."""
    hashes, seen, held, n_held, sets = _WordHash(), set(), [], 0, 0

    def frequent():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= max(3, HOT_SHARE * sets)
        return pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))

    def rows(ids, keys, classes, sizes, counts, sketches):
        return pa.RecordBatch.from_arrays([ids, keys, classes, sizes, counts, pa.array(sketches, pa.binary())], ["doc_id", "k", "cls", "n_shingles", "often", "sketch"])

    id_type = pa.null()
    for batch in batches:
        classes, sizes, sketches = [], [], []
        for features in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), hashes):
            sizes.append(len(features))
            classes.append(_class(features) if len(features) else None)
            sketches.append(sketch(features))
            if len(features) and classes[-1] not in seen:
                seen.add(classes[-1])
                held.append(features)
                n_held, sets = n_held + len(features), sets + 1
        id_type = batch.column(0).type
        yield rows(batch.column(0), batch.column(2), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64()), sketches)
        if n_held > 2_000_000:
            values, n = frequent()
            yield rows(pa.nulls(len(n), id_type), pa.nulls(len(n), pa.int64()), values, pa.array([-1] * len(n), pa.int64()), n, [None] * len(n))
            seen, held, n_held, sets = set(), [], 0, 0
    if held:
        values, n = frequent()
        yield rows(pa.nulls(len(n), id_type), pa.nulls(len(n), pa.int64()), values, pa.array([-1] * len(n), pa.int64()), n, [None] * len(n))


def _signed(hot: np.ndarray):
    def sign(batches):
        hashes, seen, frequent = _WordHash(), set(), Frequent(hot)

        def told(sets, classes):
            sigs, of = signatures(sets, frequent)
            return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.array(classes, np.int64)[of])], ["sig", "cls"])

        for batch in batches:
            sets, classes, n = [], [], 0
            for features in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), hashes):
                if len(features) and (c := _class(features)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    sets.append(features)
                    classes.append(c)
                    n += len(features)
                    if n > CHUNK:
                        yield told(sets, classes)
                        sets, classes, n = [], [], 0
            if sets:
                yield told(sets, classes)

    return sign


def _shared(batches):
    """From rows sorted by signature and class: each further class of a signature, with the first one as hub, and how often in a
    batch; also such a hub with itself, 0 times."""
    last = None  # signature and hub of the row before
    for batch in batches:
        sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.concatenate([[last is None or sig[0] != last[0]], sig[1:] != sig[:-1]])
        starts = np.flatnonzero(new)
        hub = np.empty(len(sig), np.int64)
        if not new[0]:
            hub[: starts[0] if len(starts) else len(sig)] = last[1]
        if len(starts):
            hub[starts[0] :] = np.repeat(cls[starts], np.diff(np.append(starts, len(sig))))
        pair = np.stack([hub, cls], 1)[cls != hub]
        last = (sig[-1], hub[-1])
        pair, times = np.unique(pair, axis=0, return_counts=True)
        own = np.unique(pair[:, 0])
        pair, times = np.concatenate([pair, np.stack([own, own], 1)]), np.concatenate([times, np.zeros_like(own)])
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(times)], ["hub", "cls", "times"])


def _unpacked(packed: list[bytes]) -> list[bytes]:
    return [zstandard.decompress(x) for x in packed]


def _packed(batches):
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["cls", "text"])


def _near_sketches(batches):
    """Pairs whose sketches differ in no more cells than linked sets may differ in elements: (n + n_hub) / 7."""
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        differ = differences(batch.column("sketch").to_pylist() + batch.column("sketch_hub").to_pylist(), np.arange(m), np.arange(m, 2 * m))
        near = 7 * differ <= batch.column("n").to_numpy() + batch.column("n_hub").to_numpy()
        yield batch.select(["hub", "cls"]).filter(pa.array(near))


def compare_unit(cls: np.ndarray, component: np.ndarray, n: np.ndarray, outside: np.ndarray, sketches: list[bytes], forest: bool) -> tuple[list[tuple[int, int]], int]:
    """Pairs of different components whose sizes and sketches allow a link, one of them outside the largest component; with
    `forest`, only as many as join all that any of them would join, the most similar first. Also, how many were left out."""
    found = []
    own = np.flatnonzero(outside)
    step = max(1, 2_000_000 // len(cls))
    for i in range(0, len(own), step):
        some = own[i : i + step]
        fits = (component[some, None] != component) & (4 * n[some, None] >= 3 * n) & (3 * n[some, None] <= 4 * n)
        fits &= ~outside | (cls[some, None] < cls)  # two outside ones meet once
        a, b = np.nonzero(fits)
        a = some[a]
        differ = differences(sketches, a, b)
        near = 7 * differ <= n[a] + n[b]
        found.append((a[near], b[near], differ[near] / (n[a] + n[b])[near]))
    if not found:
        return [], 0
    left, right, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    root: dict[int, int] = {}

    def find(c):
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    order = np.lexsort((cls[right], cls[left], distance))
    for a, b in zip(left[order].tolist(), right[order].tolist(), strict=True):
        if forest:
            x, y = find(int(component[a])), find(int(component[b]))
            if x == y:
                continue
            root[x] = y
        out.append((int(min(cls[a], cls[b])), int(max(cls[a], cls[b]))))
    return out, len(left) - len(out)


def _compared(forest: bool):
    """Pairs to verify, and a row of nulls if any were left out."""

    def compare(batches):
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["hub", "cls"])
        out, left_out = [], 0
        for unit in runs(batches):
            pairs, n = compare_unit(*(unit.column(c).to_numpy() for c in ("cls", "component", "n", "outside")), unit.column("sketch").to_pylist(), forest)
            out, left_out = out + pairs, left_out + n
            if len(out) > 10_000:
                yield rows(out)
                out = []
        yield rows([*out, *([(None, None)] if left_out else [])])

    return compare


def _linked_to_hub(batches):
    """Members that are linked to their group's hub. Rows are sorted by hub and part, the hub's own text first."""
    hashes, last, features = _WordHash(), None, _NO_SET
    for batch in batches:
        hubs, classes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        links = []
        for hub, c, f in zip(hubs, classes, shingle_sets(_unpacked(batch.column(2).to_pylist()), hashes), strict=True):
            if c == hub:
                last, features = hub, f
            elif hub == last and linked(features, f):
                links.append((hub, c))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["src", "dst"])


def _verified(pairs: DataFrame, n_pairs: int, one: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among n_pairs saved (hub, cls) pairs of different classes. Only the texts of their classes are shuffled. A hub of
    many pairs gets its text in several places."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    spread = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    both = F.explode(F.array("cls", "hub")).alias("cls")
    wanted = pairs.select(both).distinct()
    places = one.select("k", "cls").join(wanted, "cls", "left_semi")
    if 2 * n_pairs <= BROADCAST_ROWS:
        places = F.broadcast(places)
    text_of = texts.select("k", "text").join(places, "k").select("cls", "text").mapInArrow(_packed, "cls long, text binary")
    # Rows with equal doc_id and text have one k, so a class may come twice; a repeated hub or member adds no link.
    placed = spread.select("hub", "part", both).distinct().join(text_of, "cls").select("hub", "cls", "text", "part").repartition("hub", "part")
    return placed.sortWithinPartitions("hub", "part", F.col("cls") != F.col("hub")).select("hub", "cls", "text").mapInArrow(_linked_to_hub, "src long, dst long")


def _units(groups: DataFrame, components: DataFrame, one: DataFrame) -> DataFrame:
    """Rows (unit, cls, component, n, outside, sketch) of the groups of three or more that hold several components. Pairs of a group of
    two are verified before.

    The members outside a group's largest component meet all members, in units of bounded size: a group of m members with r
    outside makes about r * m / TOGETHER ** 2 units, one if both fit.
    """
    inside = groups.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    held = inside.groupBy("hub", "component").agg(F.count("*").alias("m"))
    mixed = held.groupBy("hub").agg(F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("c")).where("c > 1 and m > 2")
    blocks = lambda m: F.ceil(m / TOGETHER).cast("int")
    mixed = mixed.select("hub", F.col("top.component").alias("main"), blocks(F.col("m")).alias("all"), blocks(F.col("m") - F.col("top.m")).alias("rest"))
    rows = inside.join(mixed, "hub").withColumn("outside", F.col("component") != F.col("main"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("cls", F.lit(1)), "all")).withColumn("y", F.pmod(F.xxhash64("cls", F.lit(2)), "rest"))
    # A unit (x, y) holds all members of block x, and the outside ones of block y, which are compared there: a member is in the
    # units (x, 0), (x, 1), ... of its row, and an outside one in the others of its column too.
    every = F.sequence(F.lit(0), F.when(F.col("outside"), F.col("rest") + F.col("all")).otherwise(F.col("rest")) - 1)
    placed = rows.withColumn("at", F.explode(every)).where("at < rest or at - rest != x")
    in_row = F.col("at") < F.col("rest")
    x, y = F.when(in_row, F.col("x")).otherwise((F.col("at") - F.col("rest")).cast("long")), F.when(in_row, F.col("at").cast("long")).otherwise(F.col("y"))
    outside = F.col("outside") & (~in_row | (F.col("at") == F.col("y")))
    placed = placed.select(F.xxhash64("hub", x, y).alias("unit"), "cls", "component", outside.alias("outside"))
    return placed.join(one.select("cls", "n", "sketch"), "cls")


def _near_in_groups(groups: DataFrame, components: DataFrame, one: DataFrame, texts: DataFrame, forest: bool) -> tuple[DataFrame | None, bool]:
    """Links found in groups that hold several components, None if no pair comes near, and whether pairs were left out."""
    units = _units(groups, components, one).select("unit", "cls", "component", "n", "outside", "sketch")
    near = saved(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compared(forest), "hub long, cls long").distinct())
    n_rows, n_pairs = near.agg(F.count("*"), F.count("hub")).first()
    out = saved(_verified(near.where("hub is not null"), n_pairs, one, texts)) if n_pairs else None
    discard(near)
    return out, n_rows > n_pairs


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    component_id is the smallest doc_id that links reach, itself included. Null, empty and blank texts have no shingles and no
    links. Repeated rows are equal sets and so linked; a null doc_id is never a component's name unless nothing else is in it.
    """
    spark = docs.sparkSession
    arrow_sized(spark)
    texts = keyed(docs, id_col, text_col)
    id_type = texts.schema[0].dataType.simpleString()
    rows = saved(texts.mapInArrow(_sets, f"doc_id {id_type}, k long, cls long, n_shingles long, often long, sketch binary"))
    members = rows.where("n_shingles >= 0").select("doc_id", "k", "cls", "n_shingles", "sketch")
    n_rows = members.count()
    often = rows.where("n_shingles < 0").groupBy("cls").agg(F.sum("often").alias("n")).where(F.col("n") >= max(20.0, HOT_SHARE * n_rows))
    hot = np.sort(np.array([r["cls"] for r in often.collect()], np.int64).view(np.uint64))  # bounded, see HOT_SHARE

    signed = texts.select("text").mapInArrow(_signed(hot), "sig long, cls long")
    met = signed.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_shared, "hub long, cls long, times long")
    groups = saved(met.groupBy("hub", "cls").agg(F.sum("times").alias("times")))
    pairs = groups.where("cls != hub")
    one = members.where("cls is not null").groupBy("cls").agg(F.min("k").alias("k"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    one = saved(one.join(groups.select("cls").distinct(), "cls", "left_semi"))

    # The closest hub of each class, and the one class of each hub that has no other: `_units` compares the larger groups.
    first = pairs.groupBy("cls").agg(F.max(F.struct("times", "hub")).alias("best")).select("best.hub", "cls")
    alone = pairs.groupBy("hub").agg(F.min("cls").alias("cls"), F.count("*").alias("m")).where("m = 1").select("hub", "cls")
    closest = first.union(alone).distinct().join(one.select("cls", "n", "sketch"), "cls")
    hubs = one.select(F.col("cls").alias("hub"), F.col("n").alias("n_hub"), F.col("sketch").alias("sketch_hub"))
    sized = closest.join(hubs, "hub").where("4 * n >= 3 * n_hub and 4 * n_hub >= 3 * n")
    near = saved(sized.mapInArrow(_near_sketches, "hub long, cls long"))
    found = connected_components(_verified(near, near.count(), one, texts))
    for forest in (True, False):
        more, left_out = _near_in_groups(groups, found, one, texts, forest)
        if more is not None:
            was, found = found, found if more.isEmpty() else joined_components(found, more)
            discard(more, *([was] if found is not was else []))
        if not left_out:
            break

    named = saved(members.drop("k", "sketch").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    discard(rows, groups, one, near, found)
    names = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("name"))
    return named.join(names, "component", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`: doc_id, n_shingles, component_id."""
    return jaccard_components(documents(spark, sf_dir))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""
