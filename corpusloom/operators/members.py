"""Whole-text membership in a corpus by the matching-block ratio, without comparing all pairs and without losing one.

Normalised texts have 38 characters. For a text of the corpus of 200 characters and more the ratio leaves out common
characters (more than a hundredth of the text): a matching block then holds a rare character, or it is a beginning that
both texts share. So rare characters part such a text into runs, and a run is matched beyond its edges only if the s
characters at one of its ends stand in the other text too. With M characters to be matched for the ratio,

    M <= rare characters + edges of all runs + what the runs with a matched end hold beyond their edges.

s is as long as edges allow, so that hardly any other text has an end by chance. Only as many runs as the bound can't do
without are the index, the longest and least frequent first: one of their ends stands in any text that reaches the ratio,
and the sum over them decides. Shorter texts, and those with hardly a common character, are compared by their letter
pairs, block by block: blocks are parted by characters that match nothing, so two texts of T characters share at least
3M - T - 1 pairs. Only pairs that pass are compared character by character. Ends of an item that no text of the corpus
has are dropped where they are made, by sketches of fixed size.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from difflib import SequenceMatcher
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.staging import staged

#: From this length on the ratio leaves out common characters (a rule of the ratio).
LONG = 200
#: Lengths of the ends of runs that are tried, the longest first, and the share of a text that edges may take.
ENDS, EDGES = (18, 16, 14, 12, 10, 8, 6, 4, 3), 0.7
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789' "
CODES = np.zeros(256, np.int64)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
#: Keys in one batch of rows that a task makes.
KEYS = 200_000
#: Bits of a sketch of the ends in the index (a prime below 2 ** 27, 16 MB).
BITS = 134_217_689
#: Where an end stands: it begins with a rare character, it ends with one, or it begins the text.
AFTER, BEFORE, START = 1, 2, 3
#: What a character counts in a key, the base of keys (odd) and its inverse, what is added for the length and the place of an end.
COUNTS, MARKS = (np.random.default_rng(k).integers(-(2**63), 2**63 - 1, size) for k, size in ((1, len(ALPHABET) + 1), (2, (len(ENDS), 4))))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
#: Ends that stand in fewer texts count as rare. Ends that a task counts at a time.
OFTEN, COUNTED = 8, 2_000_000
#: Numbers that letter pairs are counted under, texts of a block that is compared with another one.
PAIRS, BLOCK = 1021, 2048
#: Texts of a bucket that are compared in one place, and pairs of like characters that are held for two texts at most.
BUCKET, CELLS = 256, 2_000_000
#: Rows of two and more characters that two long texts may share for their blocks to be looked for one by one.
FEW = 300


def codes_of(text: pa.StringScalar) -> np.ndarray:
    """The characters of a normalised text as numbers from 1 on."""
    return CODES[np.frombuffer(text.as_buffer(), np.uint8)]


def rare_places(codes: np.ndarray) -> np.ndarray:
    """Places of characters that make up no more than a hundredth of a long text."""
    count = np.bincount(codes, minlength=len(ALPHABET) + 1)
    return np.flatnonzero(count[codes] <= len(codes) // 100 + 1)


@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, ...]:
    """The first n powers of the base of keys and of its inverse, in 64 bits."""
    factors = np.array([[BASE], [INVERSE]], np.uint64).repeat(n, axis=1)
    factors[:, 0] = 1
    return tuple(factors.cumprod(axis=1, dtype=np.uint64).view(np.int64))


def sums_of(codes: np.ndarray) -> np.ndarray:
    """What the characters before each place count, of which the keys of ends are made."""
    power = powers(1 << max(17, len(codes).bit_length()))[0]
    return np.concatenate(([0], (COUNTS[codes] * power[: len(codes)]).cumsum()))


def ends_of(sums: np.ndarray, places: np.ndarray, s: int, place: int) -> np.ndarray:
    """The keys of the ends of s characters that begin at the places (BEFORE: that end there), all of which fit in."""
    first = places - s + 1 if place == BEFORE else places
    return (sums[first + s] - sums[first]) * powers(1 << max(17, len(sums).bit_length()))[1][first] + MARKS[ENDS.index(s), place]


def runs_of(codes: np.ndarray, s: int) -> tuple[int, np.ndarray, np.ndarray]:
    """What rare characters and the edges of runs hold at most, the places around runs, what each holds beyond its edges."""
    rare, n = rare_places(codes), len(codes)
    bounds = np.concatenate(([-1], rare, [n]))
    size = np.diff(bounds) - 1
    edge = np.full(len(size), 2 * (s - 2))
    edge[0] += 1  # a beginning of the text has no rare character in it
    if len(size) > 1:
        edge[-1] = s - 2
    return len(rare) + int(np.minimum(size, edge).sum()), bounds, size - edge


def keys_of(codes: np.ndarray, s: int, bounds: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """Columns of (key, run, what it holds beyond its edges, place) for both ends of each run that holds any."""
    run, n, sums = np.flatnonzero(beyond > 0), len(codes), sums_of(codes)
    if not len(run):
        return np.empty((4, 0), np.int64)
    places = np.maximum(bounds[run], 0)
    first = ends_of(sums, places, s, AFTER)
    if run[0] == 0:
        first[:1] = ends_of(sums, places[:1], s, START)
    closed = run[bounds[run + 1] < n]  # the last run has no rare character behind it
    last = ends_of(sums, bounds[closed + 1], s, BEFORE)
    both = np.concatenate((run, closed))
    return np.stack((np.concatenate((first, last)), both, beyond[both], np.concatenate((places, bounds[closed + 1]))))


class Packed:
    """Bytes that are sent to all tasks compressed: Python keeps what is sent as files on each executor."""

    def __init__(self, context, data: bytes):
        self.sent = context.broadcast(zlib.compress(data, 1))

    @property
    def value(self) -> bytes:
        return zlib.decompress(self.sent.value)


def least_of(n: int, near: float) -> int:
    """Characters of a text to be matched with the shortest one that allows the ratio."""
    return math.ceil(near * n / (2 - near) - 1e-6)


def chosen(codes: np.ndarray, near: float) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """s and runs_of() it for a long text, None where its pairs have to do: s is the longest whose edges leave enough."""
    if len(codes) < LONG:
        return None
    least = least_of(len(codes), near)
    for s in ENDS:
        held, bounds, beyond = runs_of(codes, s)
        if held < least and (held <= EDGES * len(codes) or s == ENDS[-1]):
            return s, held, bounds, beyond
    return None


def end_counts(batches):
    """piece, ends, counts from the corpus' long texts (norm, s): ends are the upper 32 bits of keys without the piece, the first 8."""
    keys, size = [], 0

    def told():
        ends, counts = np.unique(np.concatenate(keys), return_counts=True)
        cuts = np.searchsorted(ends, np.arange(257, dtype=np.int64) << 24)
        parts = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
        held = [[d[p].astype(np.uint32).tobytes() for _, p in parts] for d in (ends, counts)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *(pa.array(d, pa.binary()) for d in held)], names=["piece", "ends", "counts"])

    for batch in batches:
        for t, s in zip(batch.column("norm"), batch.column("s").to_pylist(), strict=True):
            codes = codes_of(t)
            found = keys_of(codes, s, *runs_of(codes, s)[1:])[0]
            keys.append(np.unique(found.view(np.uint64) >> np.uint64(32)).astype(np.int64))
            size += len(found)
            if size >= COUNTED:
                yield told()
                keys, size = [], 0
    if size:
        yield told()


def often_in(table: pa.Table) -> pa.Table:
    """piece, slots of a piece: for each of the next 16 bits of its keys the logarithm of how many texts have one, 0 below OFTEN."""
    ends, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("ends", "counts"))
    ends, at = np.unique(ends, return_inverse=True)
    counts = np.bincount(at, counts)
    slots, often = np.zeros(1 << 16, np.uint8), counts >= OFTEN
    np.maximum.at(slots, ends[often] >> 8 & 0xFFFF, np.log2(counts[often]).astype(np.uint8))
    return pa.table({"piece": table.column("piece")[:1], "slots": pa.array([slots.tobytes()], pa.binary())})


def often_of(y: DataFrame) -> bytes:
    """The logarithm of how many texts have an end, for the upper 24 bits of its key: 16 MB whatever the input. It only
    decides which runs go into the index, so that others share a number costs no pair."""
    counts = y.select("norm", "s").mapInArrow(end_counts, "piece int, ends binary, counts binary")
    out = bytearray(1 << 24)
    for r in counts.groupBy("piece").applyInArrow(often_in, "piece int, slots binary").toLocalIterator():
        out[r.piece << 16 : r.piece + 1 << 16] = r.slots
    return bytes(out)


def needed_runs(n: int, near: float, key: np.ndarray, run: np.ndarray, beyond: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
    """Which rows of keys_of() the bound can't do without, few and seldom ones, and what all others hold at most."""
    place, back = np.unique(run, return_inverse=True)
    times = np.bincount(back, 2.0 ** often[key.view(np.uint64) >> np.uint64(40)])
    size = np.zeros(len(place), np.int64)
    size[back] = beyond
    order = np.argsort(times / size, kind="stable")
    held = size[order].cumsum()
    last = int(np.searchsorted(held, n - least_of(n, near) + 1))
    kept = np.zeros(len(place), bool)
    kept[order[: last + 1]] = True
    return kept[back], n - int(size[kept].sum())


def owned_keys(near: float, often):
    """Rows of the index from the corpus' long texts (y, norm, s): y, n, held, key, run, beyond, place. often: Packed often_of()."""

    def made(batches):
        told = np.frombuffer(often.value, np.uint8)
        for batch in batches:
            schema = pa.schema([("y", batch.schema.field("y").type), ("n", pa.int32()), ("held", pa.int32()), ("key", pa.int64()), *((c, pa.int32()) for c in ("run", "beyond", "place"))])
            parts, size = [], 0
            for y, t, s in zip(batch.column("y"), batch.column("norm"), batch.column("s").to_pylist(), strict=True):
                codes = codes_of(t)
                found = keys_of(codes, s, *runs_of(codes, s)[1:])
                kept, held = needed_runs(len(codes), near, *found[:3], told)
                key, *rest = found[:, kept]
                one = [pa.array(np.full(len(key), v, np.int32)) for v in (len(codes), held)]
                parts.append(pa.RecordBatch.from_arrays([pa.repeat(y, len(key)), *one, pa.array(key), *(pa.array(v.astype(np.int32)) for v in rest)], schema=schema))
                size += len(key)
                if size >= KEYS:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, size = [], 0
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return made


def item_keys(*sketches):
    """Rows of the items' texts: x, n, key, its first place and how far behind its last one is, for the lengths of ends and
    the rare characters that texts of like length have; only keys that the sketches (Packed sketch_of() for 0, 1 and so on)
    may hold."""

    def made(batches):
        held = [np.frombuffer(b.value, np.uint8) for b in sketches]
        for batch in batches:
            schema = pa.schema([("x", batch.schema.field("x").type), ("n", pa.int32()), ("key", pa.int64()), ("first", pa.int32()), ("span", pa.int32())])
            parts, size = [], 0
            for x, t, sizes, rare in zip(*(batch.column(c) for c in ("x", "norm", "sizes", "rare")), strict=True):
                codes = codes_of(t)
                sums, rare, n = sums_of(codes), np.flatnonzero(rare.as_py() >> codes & 1), len(codes)
                found, places = [], []
                for s in sizes.as_py():
                    for place, at in ((AFTER, rare[: np.searchsorted(rare, n - s, "right")]), (BEFORE, rare[np.searchsorted(rare, s - 1) :]), (START, np.zeros(int(n >= s), np.int64))):
                        found.append(ends_of(sums, at, s, place))
                        places.append(at)
                found, places = np.concatenate(found), np.concatenate(places)
                for k, bits in enumerate(held):
                    place = (found >> 24 * k) % BITS
                    may = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
                    found, places = found[may], places[may]
                order = np.lexsort((places, found))
                found, places = found[order], places[order]
                cuts = np.flatnonzero(np.diff(found, prepend=found[:1] - 1)) if len(found) else order
                found, first, last = found[cuts], places[cuts], places[np.append(cuts[1:], len(places)) - 1] if len(cuts) else cuts
                parts.append(pa.RecordBatch.from_arrays([pa.repeat(x, len(found)), pa.array(np.full(len(found), n, np.int32)), pa.array(found), *(pa.array(v.astype(np.int32)) for v in (first, last - first))], schema=schema))
                size += len(found)
                if size >= KEYS:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, size = [], 0
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return made


def sketch_of(index: DataFrame, k: int = 0) -> bytes:
    """A bit for each key without its 24 k lowest bits modulo BITS: made on the executors in pieces of 4 KB, BITS / 8 bytes
    in all whatever the input."""
    place = index.select(F.pmod(F.shiftright("key", 24 * k), F.lit(BITS)).alias("p")).select(F.shiftright("p", 15).alias("piece"), F.col("p").bitwiseAND(32767).alias("bit"))
    out = bytearray((BITS >> 15) + 1 << 12)
    for r in place.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r.piece << 12 : r.piece + 1 << 12] = r.bits
    return bytes(out)


def length_class(n: Column, near: float) -> Column:
    """Texts whose lengths allow the ratio are at most one class apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log((2 - near) / near) + 1e-9)).cast("int")


def classes_near(n: Column, near: float) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: length_class(n, near) + d))


def matched_least(a: Column, b: Column, near: float) -> Column:
    """Characters that must match for the ratio (a hair less, against rounding)."""
    return F.ceil((a + b) * (near / 2) - 1e-6)


def close_long(x: DataFrame, y: DataFrame, near: float, same: bool) -> DataFrame:
    """(x, y, key) that may reach the ratio, y a long text, key of an end that both hold. x and y: one row a text, with norm;
    y with s and rare. same: texts with one id are one text."""
    kind_x, kind_y = (d.schema[c].dataType.simpleString() for d, c in ((x, "x"), (y, "y")))
    context = x.sparkSession.sparkContext
    often = Packed(context, often_of(y))
    index = y.select("y", "norm", "s").mapInArrow(owned_keys(near, often), f"y {kind_y}, n int, held int, key long, run int, beyond int, place int")
    index = staged(index, "index", "zstd")  # read for the sketches and for the join
    # what items of a class have to show: the lengths of ends and the rare characters of the texts of like length
    asked = y.select("s", "rare", classes_near(F.length("norm"), near).alias("class")).groupBy("class").agg(F.collect_set("s").alias("sizes"), F.bit_or("rare").alias("rare"))
    shown = x.withColumn("class", length_class(F.length("norm"), near)).join(F.broadcast(asked), "class").select("x", "norm", "sizes", "rare")  # one row a class
    sketches = [Packed(context, sketch_of(index, k)) for k in (0, 1)]
    shown = shown.mapInArrow(item_keys(*sketches), f"x {kind_x}, m int, key long, first int, span int")
    needed = matched_least(F.col("m"), F.col("n"), near)
    # no more is matched before or behind an end than there is in either text
    fits = (F.least("m", "n") >= needed) & (F.col("first") + F.col("span") >= needed - F.col("n") + F.col("place")) & (F.col("first") <= F.col("place") + F.col("m") - needed)
    met = index.join(shown, "key").where(fits).where("x <> y" if same else "true").select("x", "y", "run", "key", "beyond", (needed - F.col("held")).cast("int").alias("lacks"))
    # dealt by pair: each run counts once, then what a pair's runs hold is summed in the same place
    runs = met.repartition("x", "y").groupBy("x", "y", "lacks", "run").agg(F.max("beyond").alias("beyond"), F.min("key").alias("key"))
    return runs.groupBy("x", "y", "lacks").agg(F.sum("beyond").alias("found"), F.min("key").alias("key")).where("found >= lacks").select("x", "y", "key")


def pair_counts(text: bytes) -> np.ndarray:
    """How often letters, and letter pairs of each of PAIRS numbers, stand in a text."""
    codes = CODES[np.frombuffer(text, np.uint8)]
    return np.concatenate((np.bincount(codes, minlength=len(ALPHABET) + 1), np.bincount((codes[:-1] * 569 + codes[1:] * 41) % PAIRS, minlength=PAIRS)))


def blocks_met(near: float):
    """x, y, similarity of the texts of two blocks that reach the ratio: lengths, letters and letter pairs have to allow it."""

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("n")
            m, n = (d.column("n").to_numpy() for d in (left, right))
            s, t = ([v.encode() for v in d.column("norm").to_pylist()] for d in (left, right))
            kind = next(k for k in (np.uint8, np.uint16, np.uint32) if max(m.max(), n.max()) <= np.iinfo(k).max)
            b, texts, letters = np.array([pair_counts(v) for v in t], kind), {}, len(ALPHABET) + 1
            for i, size in enumerate(m.tolist()):
                u, v = np.searchsorted(n, size * near / (2 - near) - 1), np.searchsorted(n, size * (2 - near) / near + 1, "right")
                least, a = np.ceil((size + n[u:v]) * (near / 2) - 1e-6), pair_counts(s[i]).astype(kind)
                j = u + np.flatnonzero((np.minimum(size, n[u:v]) >= least) & (np.minimum(a[:letters], b[u:v, :letters]).sum(axis=1, dtype=np.int64) >= least))
                if not len(j):
                    continue
                shared = np.minimum(a[letters:], b[j, letters:]).sum(axis=1, dtype=np.int64)
                one = Text(s[i])
                for k in j[shared >= 3 * least[j - u] - size - n[j] - 1].tolist():
                    if (r := ratio(one, texts.get(k) or texts.setdefault(k, Text(t[k])), near)) is not None:
                        found.append((i, k, r))
        i, j, r = zip(*found, strict=True) if found else ((),) * 3
        return pa.table({"x": left.column("x").take(pa.array(i, pa.int64())), "y": right.column("y").take(pa.array(j, pa.int64())), "similarity": pa.array(r, pa.float64())})

    return met


def close_short(x: DataFrame, y: DataFrame, near: float, same: bool) -> DataFrame:
    """x, y, similarity that reach the ratio: texts of like length in blocks, each compared with each in memory. x and y: one row
    a text, with norm; same: texts with one id are one text."""
    kind_x, kind_y = (d.schema[c].dataType.simpleString() for d, c in ((x, "x"), (y, "y")))
    sized = lambda d: d.withColumn("n", F.length("norm").cast("long")).withColumn("class", length_class(F.length("norm"), near))
    x, y = sized(x), sized(y)
    total = lambda d: {r["class"]: -(-r["count"] // BLOCK) for r in d.groupBy("class").count().collect()}  # noqa: E731  a row a class
    blocks_y = total(y)
    x = x.where(F.col("class").isin(sorted({c + d for c in blocks_y for d in (-1, 0, 1)})))
    blocks_x = total(x)

    def dealt(rows: DataFrame, key: str, own: dict, other: dict, names: tuple) -> DataFrame:
        block = lambda of, c: F.create_map(*(F.lit(v) for k in sorted(of) for v in (k, of[k])))[c]
        rows = rows.withColumn("b", F.pmod(F.xxhash64(key), block(own, F.col("class")).cast("long")).cast("int"))
        rows = rows.withColumn("c", F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1))))).withColumn("k", block(other, F.col("c"))).where("k is not null")
        return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(key, "n", "norm", *(F.col(c).alias(a) for c, a in zip(("class", "b", "c", "k"), names, strict=True)))

    if not blocks_x:
        return x.join(y.select("y"), F.lit(False)).select("x", "y", F.lit(1.0).alias("similarity"))
    names = ("cx", "bx", "cy", "by")
    left, right = dealt(x, "x", blocks_x, blocks_y, names), dealt(y, "y", blocks_y, blocks_x, names[2:] + names[:2])
    met = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(blocks_met(near), f"x {kind_x}, y {kind_y}, similarity double")
    return met.where("x <> y") if same else met


def described(near: float):
    """Adds s, the length of the ends that stand for a text (0: its pairs have to do), and its rare characters to norm."""

    def made(batches):
        for batch in batches:
            sizes, rares = [], []
            for t in batch.column("norm"):
                codes = codes_of(t)
                found = chosen(codes, near)
                sizes.append(found[0] if found else 0)
                rares.append(int(np.bitwise_or.reduce(1 << np.unique(codes[found[2][1:-1]]), initial=0)) if found else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(rares, pa.int64())], names=[*batch.schema.names, "s", "rare"])

    return made


def described_texts(rows: DataFrame, near: float, name: str) -> DataFrame:
    """rows (with norm) with s and rare, written once."""
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return staged(rows.mapInArrow(described(near), f"{kinds}, s int, rare long"), name, "zstd")


def runs_allow(a: str, b: str, least: int) -> bool:
    """Whether rare characters and runs of b allow least matched characters: of a long text's run no more than a beginning
    that stands in a after the rare character before it, and an end that stands there before the one behind it."""
    if len(b) < LONG:
        return True
    codes = CODES[np.frombuffer(b.encode(), np.uint8)]
    rare, n = rare_places(codes), len(b)
    counts = [np.bincount(c, minlength=len(ALPHABET) + 1) for c in (CODES[np.frombuffer(a.encode(), np.uint8)], codes)]
    left = int(np.minimum(*counts)[np.unique(codes[rare])].sum()) + n - len(rare)
    before = -1
    for behind in (*rare.tolist(), n):
        size, p, q = behind - before - 1, 0, 0
        if size:
            if before < 0:
                while p < size and p < len(a) and a[p] == b[p]:
                    p += 1
            else:
                at = 0
                while p < size and (at := a.find(b[before : before + p + 2], at)) >= 0:
                    p += 1
            if behind < n:
                at = len(a)
                while p + q < size and (at := a.rfind(b[behind - q - 1 : behind + 1], 0, at)) >= 0:
                    q, at = q + 1, at + q + 2
            left -= size - p - q
            if left < least:
                return False
        before = behind
    return True


def may_match(a: str | bytes, b: str | bytes, least: int) -> bool:
    """Whether least characters of a stand in b in the same order: no matching blocks hold more. The row of the longest
    common subsequence is one number, a bit a character of b; it stops as soon as too few of a are left."""
    at: dict = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, n = full, len(a)
    for i, c in enumerate(a, 1):
        met = row & at.get(c, 0)
        row = (row + met | row - met) & full
        if not i & 31 and len(b) - row.bit_count() + n - i < least:
            return False
    return len(b) - row.bit_count() >= least


class Text:
    """A normalised text: its bytes, the numbers and counts of its characters, which are no common ones."""

    def __init__(self, text: bytes):
        self.text, self.codes = text, CODES[np.frombuffer(text, np.uint8)]
        self.count = np.bincount(self.codes, minlength=len(ALPHABET) + 1)
        self.rare = self.count <= len(text) // 100 + 1 if len(text) >= LONG else self.count >= 0

    @cached_property
    def rare_at(self) -> np.ndarray:
        return np.flatnonzero(self.rare[self.codes])

    @cached_property
    def grouped(self) -> tuple[np.ndarray, np.ndarray]:
        """Places by character, and where those of each character begin."""
        return np.argsort(self.codes, kind="stable"), np.concatenate(([0], self.count.cumsum()[:-1]))

    @cached_property
    def at(self) -> dict[int, list[int]]:
        """The places of each character (a byte) that isn't common."""
        found = {}
        for k in self.rare_at.tolist():
            found.setdefault(self.text[k], []).append(k)
        return found

    @cached_property
    def twos(self) -> dict[bytes, list[int]]:
        """The second places of two neighbours that aren't common."""
        found = {}
        for k in self.rare_at[1:][np.diff(self.rare_at) == 1].tolist():
            found.setdefault(self.text[k - 1 : k + 1], []).append(k)
        return found


def rows_of_two(x: Text, y: Text) -> list[tuple[int, int, int]] | None:
    """(end in x, end in y, length) of rows of two and more characters of both that aren't common in y; None if more than FEW."""
    a, b, found = x.text, y.text, []
    for two, ends in y.twos.items():
        i = a.find(two) + 1
        while i > 0:
            if len(found) + len(ends) > FEW:
                return None
            for j in ends:
                k = 2
                while i >= k and j >= k and a[i - k] == b[j - k] and y.rare[y.codes[j - k]]:
                    k += 1
                found.append((i, j, k))
            i = a.find(two, i) + 1
    return found


def one_by_one(x: Text, y: Text, rows: list[tuple[int, int, int]]):
    """The longest row in a part of both texts, looked for when it is asked for: few rows are longer than one character."""
    a, at, places = x.text, y.at, np.flatnonzero(y.rare[x.codes]).tolist()

    def best(a0: int, a1: int, b0: int, b1: int, _):
        found = None
        for i, j, k in rows:
            if a0 <= i < a1 and b0 <= j < b1 and (k := min(k, i - a0 + 1, j - b0 + 1)) > 1 and (found is None or (-k, i, j) < found):
                found = (-k, i, j)
        if found:
            return found[1], found[2], -found[0]
        for k in range(bisect_left(places, a0), bisect_left(places, a1)):
            if (ends := at.get(a[places[k]])) and (q := bisect_left(ends, b0)) < len(ends) and ends[q] < b1:
                return places[k], ends[q], 1
        return None

    return best, lambda cells, p, q, right: None, None


def all_at_once(x: Text, y: Text, times: np.ndarray):
    """As one_by_one() from all pairs of like places."""
    n, (places, first) = len(y.text), x.grouped
    letters, cells = y.codes[y.rare_at], int(times.sum())
    j = np.repeat(y.rare_at, times)
    i = places[np.arange(cells) + np.repeat(first[letters] - times.cumsum() + times, times)]
    size, at, back = np.ones(cells, np.int64), np.arange(cells), 1
    while len(at):  # how long the row of characters is that ends at each pair of places
        at = at[(i[at] >= back) & (j[at] >= back)]
        code = y.codes[j[at] - back]
        at = at[(x.codes[i[at] - back] == code) & y.rare[code]]
        size[at] += 1
        back += 1

    def best(a0: int, a1: int, b0: int, b1: int, cells):
        i, j, size = cells
        k = int((i * n + j - size * (len(x.text) * n)).argmin()) if len(i) else None
        return None if k is None else (int(i[k]), int(j[k]), int(size[k]))

    def narrow(cells, p: int, q: int, right: bool):
        i, j, size = cells
        part = (i >= p) & (j >= q) if right else (i < p) & (j < q)
        i, j, size = i[part], j[part], size[part]  # a row doesn't reach into what is matched
        return i, j, np.minimum(size, np.minimum(i - p, j - q) + 1) if right else size

    return best, narrow, (i, j, size)


def ratio(x: Text, y: Text, near: float) -> float | None:
    """The matching-block ratio of two texts, None where it is below near. As SequenceMatcher finds the blocks: the longest row
    of characters that aren't common in y, at a tie the first in x, then in y, and what is equal around it; then left and
    right of it. It stops as soon as what is matched and left can't reach near."""
    a, b, m, n = x.text, y.text, len(x.text), len(y.text)
    least = math.ceil((near / 2) * (m + n) - 1e-6)
    if min(m, n) < least or int(np.minimum(x.count, y.count).sum()) < least or (n < LONG and not may_match(a, b, least)):
        return None
    if n >= LONG and (rows := rows_of_two(x, y)) is not None:
        best, narrow, cells = one_by_one(x, y, rows)
    else:
        times = x.count[y.codes[y.rare_at]]
        if int(times.sum()) > CELLS:
            s, t = a.decode(), b.decode()
            found = SequenceMatcher(None, s, t).ratio() if runs_allow(s, t, least) and may_match(s, t, least) else 0.0
            return found if found >= near else None
        best, narrow, cells = all_at_once(x, y, times)
    matched, left, rest = 0, min(m, n), [(0, m, 0, n, cells)]
    while rest:
        a0, a1, b0, b1, cells = rest.pop()
        left -= min(a1 - a0, b1 - b0)
        u, v, p, q = a0, b0, a0, b0
        if hit := best(a0, a1, b0, b1, cells):
            p, q = hit[0] + 1, hit[1] + 1
            u, v = p - hit[2], q - hit[2]
            while u > a0 and v > b0 and a[u - 1] == b[v - 1]:
                u, v = u - 1, v - 1
        while p < a1 and q < b1 and a[p] == b[q]:
            p, q = p + 1, q + 1
        if p > u:
            matched += p - u
            parts = [(a0, u, b0, v)] if u > a0 and v > b0 else []
            parts += [(p, a1, q, b1)] if p < a1 and q < b1 else []
            for one in sorted(parts, key=lambda r: min(r[1] - r[0], r[3] - r[2])):
                left += min(one[1] - one[0], one[3] - one[2])
                rest.append((*one, narrow(cells, p, q, True) if one[0] == p else narrow(cells, u, v, False)))
        if matched + left < least:
            return None
    found = 2.0 * matched / (m + n)
    return found if found >= near else None


def sketched(sketch):
    """Rows whose key the sketch (Packed sketch_of()) may hold."""

    def kept(batches):
        bits = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            place = batch.column("key").to_numpy() % BITS
            yield batch.filter(pa.array(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0))

    return kept


def texts_in(pairs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The rows of texts that stand in pairs, and few others."""
    hashed = F.xxhash64(key).alias("key")
    sketch = Packed(pairs.sparkSession.sparkContext, sketch_of(pairs.select(hashed)))
    rows = texts.select("*", hashed)
    return rows.mapInArrow(sketched(sketch), ", ".join(f"{c} {t}" for c, t in rows.dtypes)).drop("key")


def ends_held(text: bytes, s: int, rare: np.ndarray) -> np.ndarray:
    """The keys of all ends of s characters of an item's text whose outer character is one of the rare ones, in order."""
    codes = CODES[np.frombuffer(text, np.uint8)]
    sums, at, n = sums_of(codes), np.flatnonzero(rare[codes]), len(codes)
    parts = ((AFTER, at[: np.searchsorted(at, n - s, "right")]), (BEFORE, at[np.searchsorted(at, s - 1) :]), (START, np.zeros(int(n >= s), np.int64)))
    return np.sort(np.concatenate([ends_of(sums, k, s, place) for place, k in parts]))


def compared(near: float):
    """x, y, similarity of the pairs of a bucket that reach the ratio. Its rows: texts (x or y, norm, s of a y), pairs (x, y). A
    pair is compared if all runs of y with an end that x holds, not only those in the index, allow the ratio."""

    def of(table: pa.Table) -> pa.Table:
        texts, sizes, pairs, found = ({}, {}), {}, [], []
        for x, y, t, s in zip(*(table.column(c).to_pylist() for c in ("x", "y", "norm", "s")), strict=True):
            if t is None:
                pairs.append((x, y))
            else:
                texts[x is None][y if x is None else x] = t.encode()
                if x is None:
                    sizes[y] = s
        runs, rare, two = {}, np.zeros(len(ALPHABET) + 1, bool), {}
        for y, s in sizes.items():
            codes = CODES[np.frombuffer(texts[1][y], np.uint8)]
            held, bounds, beyond = runs_of(codes, s)
            runs[y] = held, *keys_of(codes, s, bounds, beyond)[:2], np.maximum(beyond, 0)
            rare[codes[bounds[1:-1]]] = True
        last, one, ends = None, None, {}
        for x, y in sorted(pairs):
            if x != last or not ends:
                last, one, ends = x, None, {}
            s, (held, key, run, beyond) = sizes[y], runs[y]
            if s not in ends:
                ends[s] = ends_held(texts[0][x], s, rare)
            of_x = ends[s]
            shown = np.zeros(len(beyond), bool)
            if len(of_x):
                shown[run[of_x[np.minimum(np.searchsorted(of_x, key), len(of_x) - 1)] == key]] = True
            if held + int(beyond[shown].sum()) < math.ceil((near / 2) * (len(texts[0][x]) + len(texts[1][y])) - 1e-6):
                continue
            one = one or Text(texts[0][x])
            other = two.get(y) or two.setdefault(y, Text(texts[1][y]))
            if (r := ratio(one, other, near)) is not None:
                found.append((x, y, r))
        x, y, r = zip(*found, strict=True) if found else ((),) * 3
        return pa.table({"x": pa.array(x, table.schema.field("x").type), "y": pa.array(y, table.schema.field("y").type), "similarity": pa.array(r, pa.float64())})

    return of


def bucketed(pairs: DataFrame, x: DataFrame, y: DataFrame, near: float) -> DataFrame:
    """x, y, similarity of the pairs that reach the ratio. Texts are sent once to each bucket, not once a pair: pairs that share
    an end are a bucket, large ones are parted by hashes of both ids."""
    kind_x, kind_y = (d.schema[c].dataType.simpleString() for d, c in ((x, "x"), (y, "y")))
    parts = F.ceil(F.sqrt(F.col("count")) / BUCKET).alias("parts")
    many = pairs.groupBy("key").count().where(F.col("count") > BUCKET * BUCKET).select("key", parts)
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(many, "key", "left").select("x", "y", "key", part("x").alias("p"), part("y").alias("q"))
    sent = lambda d, c: dealt.select(c, "key", "p", "q").distinct().join(texts_in(pairs, d, c), c)
    none = lambda kind: F.lit(None).cast(kind)
    rows = sent(x, "x").select("key", "p", "q", "x", none(kind_y).alias("y"), "norm", none("int").alias("s"))
    rows = rows.union(sent(y, "y").select("key", "p", "q", none(kind_x), "y", "norm", "s")).union(dealt.select("key", "p", "q", "x", "y", none("string"), none("int")))
    return rows.groupBy("key", "p", "q").applyInArrow(compared(near), f"x {kind_x}, y {kind_y}, similarity double")


def similar_described(x: DataFrame, y: DataFrame, near: float, same: bool = False) -> DataFrame:
    """x, y, similarity of all pairs of different texts that reach the ratio; one row a text (id, h, norm, s, rare), h the same
    for equal texts. same: texts with one id are one text, all others differ. Close pairs are written once."""
    left, right = x.select("x", "norm"), y.select("y", "norm", "s", "rare")
    pairs = staged(close_long(left, right.where("s > 0"), near, same), "close_texts", "zstd")
    right = right.select("y", "norm", "s")
    found = bucketed(pairs, left, right, near).union(close_short(left, right.where("s = 0").drop("s"), near, same))
    if same:
        return found
    ends = found.join(x.select("x", "h"), "x").join(y.select("y", F.col("h").alias("g")), "y")
    return ends.where("h <> g").select("x", "y", "similarity")


def similar(x: DataFrame, y: DataFrame, near: float) -> DataFrame:
    """x, y, similarity of all pairs of different texts that reach the ratio; x and y hold one row a text (id, norm)."""
    hashed = lambda d: d.withColumn("h", F.sha2("norm", 256))
    return similar_described(described_texts(hashed(x), near, "item_texts"), described_texts(hashed(y), near, "corpus_texts"), near)


def membership(texts: DataFrame, corpus: DataFrame | None, item: str, text: str, account: str, owned: str, near: float | None = 0.85, exact: float = 0.995) -> DataFrame:
    """item, account, match (exact or near), similarity, matched: whether an account's corpus holds a text; without near
    only whether it holds an equal one. Without a corpus the texts are it, owned the name of their ids there.

    Equal normalised texts are exact. Else the best matching-block ratio of the normalised texts counts (exact from 0.995
    on), the smaller owned id at a tie; no pair that reaches near is lost. An item is never compared with itself (rows of
    texts and corpus with the same item and owned id). Null and empty texts, null accounts and ids are members of nothing
    and hold nothing. Copies stand for one another: a text is compared once, and of an account's copies two ids at most go
    on."""
    # a condition on norm would be pushed down and write it once more
    norm, hashed, told = T.normalised(F.col(text)), F.sha2("norm", 256), T.has_normalised(F.col(text))
    if corpus is None:
        rows = texts.where(told & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(account).alias("account"), norm.alias("norm")).withColumn("h", hashed)
        rows = rows if near is None else staged(rows, "rows", "zstd")  # normalised once for copies, owners and texts
        a, b = rows.drop("account"), rows.where("account is not null").withColumnRenamed("item", "owned")
    else:
        a = texts.where(told & F.col(item).isNotNull()).select(F.col(item).alias("item"), norm.alias("norm")).withColumn("h", hashed)
        b = corpus.where(told & F.col(owned).isNotNull() & F.col(account).isNotNull()).select(F.col(owned).alias("owned"), F.col(account).alias("account"), norm.alias("norm")).withColumn("h", hashed)
    first = F.row_number().over(W.partitionBy("account", "h").orderBy("owned"))
    owners = b.select("account", "h", "owned").distinct().withColumn("r", first).where("r <= 2").drop("r")
    items = a.select("item", "h").distinct()
    equal = items.join(owners, "h").where("item <> owned").groupBy("item", "account").agg(F.min("owned").alias("matched"))
    equal = equal.select("item", "account", F.lit("exact").alias("match"), F.lit(1.0).alias("similarity"), "matched")
    names = [F.col("item").alias(item), F.col("account").alias(account), "match", "similarity", "matched"]
    if near is None:
        return equal.select(*names)
    if corpus is None:  # texts are dealt and written once for both sides
        both = rows.groupBy("h").agg(F.min("norm").alias("norm"), F.max(F.col("account").isNotNull()).alias("owned"))
        both = described_texts(both.withColumn("x", F.monotonically_increasing_id()), near, "texts")
        x, y = both.drop("owned"), both.where("owned").drop("owned").withColumnRenamed("x", "y")
    else:
        x, y = (described_texts(d.groupBy("h").agg(F.min("norm").alias("norm")).withColumn(k, F.monotonically_increasing_id()), near, w) for d, k, w in ((a, "x", "item_texts"), (b, "y", "corpus_texts")))
    pairs = similar_described(x, y, near, corpus is None).join(x.select("x", "h"), "x").join(y.select("y", F.col("h").alias("g")), "y")
    met = items.join(pairs.select("h", "g", "similarity"), "h").join(owners.withColumnRenamed("h", "g"), "g").where("item <> owned")
    best = met.groupBy("item", "account").agg(F.min_by(F.struct("similarity", "owned"), F.struct(-F.col("similarity"), F.col("owned"))).alias("b"))
    best = best.select("item", "account", F.when(F.col("b.similarity") >= exact, "exact").otherwise("near").alias("match"), "b.similarity", F.col("b.owned").alias("matched"))
    out = equal.union(best.join(equal.select("item", "account"), ["item", "account"], "left_anti"))
    return out.select(*names)
