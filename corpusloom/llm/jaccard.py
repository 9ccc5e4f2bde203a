"""N-gram Jaccard join by count-vector R-trees.

A text's set holds its distinct word shingles. Shingles are hashed into groups, and a text's group counts are a point;
two sets can share at most the sum of the smaller coordinates, and a node of the tree, which keeps the largest counts
below it, bounds what all its points can share with a query in the same way. Points that pass are verified on the sets
themselves.

One tree over all points prunes little in so many dimensions, and all points can't stand in one task. So there is a
tree for each block: a pair at the threshold must share one of the first (1 - threshold) of either set's shingles, in
any one order of all shingles, so each text goes to the blocks of those shingles, and nothing is lost. The order puts
shingles of low hash that a single text has first: they open no blocks, so a text without near copies is in none at
all. Then come shared ones of low hash, the rarest first, then those of crowded hash buckets (counted over all texts),
then the rest by hash. Equal sets are one class from the start.

Classes of a crowd are first tied to one class of each of a few of their blocks. From then on only classes of different
components are compared, and a block within one component is left out. A point meets a few partners of a block in the
first turn; where more are left over, a further turn takes ever more of them, so no link between components is lost.
Partners are cut while a tree is walked and pairs leave a task as they come. A block beyond TILE classes stands in the
pairs of its tiles, so no task holds more than two tiles of it. The result is components: links within a component are
looked up only as far as they are needed to find it.

Shingles are compared by 64-bit hashes: sets of n and m shingles seem to share one too many with a probability of at
most n * m / 2**64, and two of D different sets get one class with at most D * D / 2**65.

A text without words, or a null one, has an empty set and links with nothing. With fewer words than a shingle has, the
whole sequence is the one shingle. Rows that share a doc_id are one document; equal rows come back as often as they
came. A row without doc_id keeps a null component and takes no part. Texts may be of any length; an empty table gives
no rows; columns beside doc_id and text play no part, and keep() passes them on under any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from corpusloom.llm.common import components, materialise, small_batches

WORDS, PERCENT = 5, 75
#: Hash buckets in which shingles are counted to find crowded ones; the counts have this size at any input size.
BUCKETS = 1 << 20
SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
#: Share of low hashes, as a multiple of the share of shingles that blocks are opened for.
LOW = 1.6
#: Children of a node, and points of a block that one leaf holds.
FANOUT, LEAF = 16, 64
#: Classes of a block beyond which its pairs are bounded block by block.
CROWD = 6
#: Blocks of a class in which it is tied to one other class.
TIED = 6
#: Partners that a point of a block is tied to in the first turn, and by how much each later turn multiplies them.
TIES, WIDER = 3, 64
#: Pairs that a task holds before it hands them on, leaf points looked at together, shingles in a part, classes in a
#: part of blocks, classes in a tile.
HELD, STRIDE, PART, BLOCKS, TILE = 1 << 20, 1024, 1 << 20, 1 << 14, 4096
#: Shingles in a group, and the most groups of a point.
EACH, GROUPS = 0.5, 1 << 14
#: Bytes of points that are compared at a time.
CHUNK = 1 << 24
#: Bits that mark the documents whose sets are needed; more documents than that only mean more sets built.
MARKS = 1 << 25

_odd = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The sorted set of hashed shingles of each text, A-Z in lower case; white space is that of ASCII."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words = pc.list_flatten(lists).dictionary_encode()
    distinct = words.dictionary.cast(pa.binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[words.indices.to_numpy()]
    total = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        total += h[k : k + len(total)] * np.uint64(_odd[k])
    total = _mixed(total)
    out, at = [], 0
    for i, n in enumerate(pc.list_value_length(lists).to_pylist()):
        if n >= size:
            found = np.sort(total[at : at + n - size + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:  # an empty text is one empty word
            whole = b" ".join(w.encode() for w in lists[i].as_py())
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0" + whole)], np.uint64) if whole else np.empty(0, np.uint64))
        at += n
    return out


def class_of(found: np.ndarray) -> int:
    """The class of equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def point(found: np.ndarray, each: float = EACH) -> bytes:
    """Group counts: a power of two of groups, about so many shingles each. Counts beyond a byte's range stay at its
    end, where 255 means no bound."""
    groups = max(8, min(GROUPS, 1 << max(1, int(len(found) / each)).bit_length()))
    return np.minimum(np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def needed(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of sets of n and m elements at the threshold: 100 * i >= percent * (n + m - i)."""
    return -(-(percent * (n.astype(np.int64) + m)) // (100 + percent))


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points in fewer groups: halves are added, 255 stays."""
    while points.shape[1] > groups:
        half = points.shape[1] // 2
        points = np.where((points[:, :half] == 255) | (points[:, half:] == 255), 255, np.minimum(points[:, :half].astype(np.int16) + points[:, half:], 255)).astype(np.uint8)
    return points


def shared_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and of b, the sum of the smaller coordinates; without a bound if both counts are 255."""
    low = np.minimum(a[:, None, :], b[None, :, :])
    return np.where((low == 255).any(2), 1 << 40, low.sum(2, dtype=np.int64))


class Tree:
    """An R-tree over points of about equal size: leaves of FANOUT points in the given order, nodes with their largest counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            high, small, large = self.levels[-1]
            cuts = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)))

    def near(self, query: np.ndarray, size: int, percent: int, first: int, most: int, back: bool, groups: np.ndarray, group: int) -> np.ndarray:
        """Indices, from first on and in other groups, of points that may be at the threshold with the query: all of
        them, or more than most, from the end if back."""

        def fits(k: int, at: np.ndarray) -> np.ndarray:
            high, small, large = (x[at] for x in self.levels[k])
            passed = (100 * large >= percent * size) & (percent * small <= 100 * size)
            least = needed(np.maximum(small, -(-percent * size // 100)), np.int64(size), percent)
            return passed & (shared_at_most(query[None], high)[0] >= least)

        at = np.arange(first // FANOUT ** (len(self.levels) - 1), len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, 0, -1):
            at = (at[fits(k, at)][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[(at >= first // FANOUT ** (k - 1)) & (at < len(self.levels[k - 1][0]))]
        at = at[groups[at] != group]
        at = at[::-1] if back else at
        found, n = [np.empty(0, np.int64)], 0
        for x in range(0, len(at), STRIDE):
            here = at[x : x + STRIDE]
            found.append(here[fits(0, here)])
            n += len(found[-1])
            if n > most:
                break
        return np.concatenate(found)


def partners(turn: int) -> int:
    """Partners among those after it that a point of a block is tied to in a turn."""
    return TIES * WIDER**turn


def block_pairs(ids: np.ndarray, sizes: np.ndarray, points: list[bytes], groups: np.ndarray, percent: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of a block (as places in it) of different groups that pass the bound, a lot at a time, and whether a point
    of the lot has more partners than the turn ties. Even turns take partners from the end of the block, so that all
    points meet the same few, odd ones the nearest in size."""
    if (groups == groups[0]).all():
        return
    order = np.lexsort((ids, sizes))
    for i, j, crowded in (_leaf if len(ids) <= LEAF else _tree)(sizes[order], [points[k] for k in order], groups[order], percent, partners(turn), turn % 2 == 0):
        yield order[i], order[j], crowded


def bounded(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, points: list[bytes], percent: int) -> np.ndarray:
    """Which index pairs (i the smaller set) may be at the threshold by their counts."""
    widths = np.array([len(p) for p in points])
    passed = np.zeros(len(i), bool)
    for w, v in np.unique(np.stack([widths[i], widths[j]], 1), axis=0).tolist() if len(i) else []:
        here = np.flatnonzero((widths[i] == w) & (widths[j] == v))
        step = max(1, CHUNK // v)
        for k in (here[x : x + step] for x in range(0, len(here), step)):
            a = np.frombuffer(b"".join(points[x] for x in i[k]), np.uint8).reshape(len(k), w)
            b = folded(np.frombuffer(b"".join(points[x] for x in j[k]), np.uint8).reshape(len(k), v), w)
            low = np.minimum(a, b)
            most = np.where((low == 255).any(1), 1 << 40, low.sum(1, dtype=np.int64))
            passed[k] = most >= needed(sizes[i[k]], sizes[j[k]], percent)
    return passed


def _leaf(sizes: np.ndarray, points: list[bytes], groups: np.ndarray, percent: int, most: int, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs of a block of one leaf that pass the bound: sizes first, then counts."""
    fits = np.triu(100 * sizes[:, None] >= percent * sizes[None, :], 1) & (groups[:, None] != groups[None, :])
    i, j = np.nonzero(fits)
    passed = bounded(i, j, sizes, points, percent)
    i, j = i[passed], j[passed]
    place = np.searchsorted(i, i, "right") - 1 - np.arange(len(i)) if back else np.arange(len(i)) - np.searchsorted(i, i)
    yield i[place < most], j[place < most], bool((place >= most).any())


def small_pairs(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, points: list[bytes], groups: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of all blocks too small to be crowded: each pair is bounded once, in however many blocks it stands."""
    ones, twos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in np.unique(lengths).tolist():
        members = rows[starts[lengths == k][:, None] + np.arange(k)]
        one, two = np.triu_indices(k, 1)
        ones.append(members[:, one].ravel())
        twos.append(members[:, two].ravel())
    i, j = np.concatenate(ones), np.concatenate(twos)
    swap = (sizes[i] > sizes[j]) | ((sizes[i] == sizes[j]) & (i > j))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    fits = (100 * sizes[i] >= percent * sizes[j]) & (groups[i] != groups[j])
    packed = np.unique(i[fits] * len(sizes) + j[fits])
    i, j = packed // len(sizes), packed % len(sizes)
    passed = bounded(i, j, sizes, points, percent)
    return i[passed], j[passed]


def _tree(sizes: np.ndarray, points: list[bytes], groups: np.ndarray, percent: int, most: int, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs of a large block that pass the bound, by a tree for each width of points."""
    widths = np.array([len(p) for p in points])
    trees: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, Tree]] = {}
    for v in map(int, np.unique(widths)):
        own = np.flatnonzero(widths == v)
        stack = np.frombuffer(b"".join(points[k] for k in own), np.uint8).reshape(len(own), v)
        for w in (v, v // 2):
            trees[w, v] = own, groups[own], Tree(folded(stack, w), sizes[own])
    ones, twos, held, crowded = [], [], 0, False
    for i in range(len(sizes)):  # sizes grow along the order: partners stand later, in as wide points or twice as wide
        w = len(points[i])
        query = np.frombuffer(points[i], np.uint8)
        left = most
        for v in (2 * w, w) if back else (w, 2 * w):
            if (w, v) in trees:
                own, group, tree = trees[w, v]
                near = tree.near(query, int(sizes[i]), percent, int(np.searchsorted(own, i, "right")), left, back, group, groups[i])
                hits = own[near[: left + 1]]
                crowded |= len(hits) > left
                hits = hits[:left]
                left -= len(hits)
                ones.append(np.full(len(hits), i))
                twos.append(hits)
                held += len(hits)
        if held > HELD:
            yield np.concatenate(ones), np.concatenate(twos), crowded
            ones, twos, held = [], [], 0
    yield np.concatenate([np.empty(0, np.int64), *ones]), np.concatenate([np.empty(0, np.int64), *twos]), crowded


def marks(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, cid, low (the shingles of low hash, and so many at least as blocks are opened for) of each row,
    written once, and the count of each hash bucket over all sets."""
    slices, names = 64, ["doc_id", "n", "cid", "low", "slice", "counts"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    least = low_hashes(percent)

    def build(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            sets = shingle_sets(rows.column("text"), size)
            n = [len(x) for x in sets]
            cid = [class_of(x) if len(x) else None for x in sets]
            low = [x[: max(int(np.searchsorted(x, least)), opened(len(x), percent))].tobytes() for x in sets]
            if sets:
                seen += np.bincount((np.concatenate(sets) >> SHIFT).astype(np.int64), minlength=BUCKETS)
            columns = (rows.column("doc_id"), n, cid, low)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, types, strict=True)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        parts = seen.astype(np.int32).reshape(slices, -1)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(slices, t) for t in types), pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // slices, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.int32)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "doc_id long, n long, cid long, low binary, slice int, counts binary")
    rows = materialise(rows, "sets")
    sums = rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(added, "slice int, counts binary").collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in sums:
        counts.reshape(slices, -1)[r["slice"]] = np.frombuffer(r.counts, np.int64)
    return rows.where("slice is null").drop("slice", "counts"), counts


def opened(n: int, percent: int = PERCENT) -> int:
    """The number of shingles of a set of n, the first in the order, that open blocks."""
    return n - -(-percent * n // 100) + 1 if n else 0


def low_hashes(percent: int = PERCENT) -> np.uint64:
    """The hash below which shingles are low."""
    return np.uint64(min((1 << 64) - 1, int(LOW * (100 - percent) / 100 * 2**64)))


def crowded_order(counts: np.ndarray) -> np.ndarray:
    """0 for ordinary buckets, the count for those far above the mean."""
    mean = counts.mean()
    return np.where(counts > 2 * mean + 8 * np.sqrt(mean) + 8, counts, 0)


def _dealt(part: np.ndarray, data: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The parts that occur and the rows of each, as bytes."""
    order = np.argsort(part, kind="stable")
    part, data = part[order], data[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    ends = np.append(starts, len(part))[1:]
    return part[starts].tolist(), [data[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]


def _part_blobs(parts: list[int], blobs: list[bytes], kind: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


BLOBS = "part int, kind int, blob binary"


def postings(rows: DataFrame, crowd, percent: int, parts: int) -> DataFrame:
    """(part, blob) of the low shingles outside crowded buckets with their classes, by the part that their hash names."""
    least = low_hashes(percent)

    def build(batches):
        keys, cids, held, seen = [], [], 0, set()

        def flush():
            key, cid = np.concatenate(keys), np.concatenate(cids)
            return _part_blobs(*_dealt((key % np.uint64(parts)).astype(np.int32), np.stack([key, cid.view(np.uint64)], 1)))

        for batch in batches:
            for cid, low in zip(batch.column("cid").to_pylist(), batch.column("low").to_pylist(), strict=True):
                if cid in seen:
                    continue
                seen.add(cid)
                key = np.frombuffer(low, np.uint64)
                key = key[: np.searchsorted(key, least)]
                key = key[crowd.value[(key >> SHIFT).astype(np.int64)] == 0]
                keys.append(key)
                cids.append(np.full(len(key), cid, np.int64))
                held += len(key)
            if held > 2_000_000:
                yield flush()
                keys, cids, held, seen = [], [], 0, set()
        if keys:
            yield flush()

    return rows.select("cid", "low").mapInArrow(build, BLOBS)


def shared(posts: DataFrame, owners: int) -> DataFrame:
    """(part, blob) of class, shingle, its classes: for shingles of two or more classes, by the part of the class."""

    def found(table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.uint64).reshape(-1, 2)
        order = np.argsort(data[:, 0])
        key = data[order, 0]
        same = key[1:] == key[:-1]
        many = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        data = data[many]
        data = data[np.lexsort((data[:, 1], data[:, 0]))]
        if len(data):
            data = data[np.concatenate(([True], (data[1:] != data[:-1]).any(1)))]
        _, place, n = np.unique(data[:, 0], return_inverse=True, return_counts=True)
        n = n[place] if len(data) else np.empty(0, np.int64)
        data = np.concatenate([data[:, ::-1], n[:, None].astype(np.uint64)], 1)[n > 1]
        return pa.Table.from_batches([_part_blobs(*_dealt((data[:, 0] % np.uint64(owners)).astype(np.int32), data))])

    return posts.groupBy("part").applyInArrow(found, BLOBS)


def class_sums(rows: DataFrame, crowd, percent: int, owners: int) -> DataFrame:
    """(part, blob) of what a class knows by itself: class, size, its low shingles outside crowded buckets; and, where
    those are too few to open its blocks, the further shingles in their order (as kind 1: class, shingle, place)."""
    least = low_hashes(percent)

    def build(batches):
        for batch in batches:
            infos, more = [], [np.empty((0, 3), np.uint64)]
            for cid, n, low in zip(batch.column("cid").to_numpy().view(np.uint64), batch.column("n").to_pylist(), batch.column("low").to_pylist(), strict=True):
                key = np.frombuffer(low, np.uint64)
                weight = crowd.value[(key >> SHIFT).astype(np.int64)]
                high = key >= least
                plain = int((~high & (weight == 0)).sum())
                infos.append((cid, n, plain))
                lacks = opened(n, percent) - plain
                if lacks > 0:
                    rest = np.flatnonzero(high | (weight > 0))
                    rest = key[rest[np.lexsort((key[rest], np.where(high, 0, weight)[rest], high[rest]))[:lacks]]]
                    more.append(np.stack([np.full(len(rest), cid), rest, np.arange(len(rest), dtype=np.uint64)], 1))
            for kind, data in ((0, np.array(infos, np.uint64).reshape(-1, 3)), (1, np.concatenate(more))):
                yield _part_blobs(*_dealt((data[:, 0] % np.uint64(owners)).astype(np.int32), data), kind)

    return rows.select("cid", "n", "low").mapInArrow(build, BLOBS)


def opening(known: DataFrame, percent: int) -> DataFrame:
    """cid, n and the shingles that open a block of a class, in their order; no row for a class that opens none.

    known: the rows of class_sums() as they are and those of shared() as kind 2."""

    def choose(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        info, more, common = (np.frombuffer(b"".join(b for k, b in zip(kinds, blobs, strict=True) if k == kind), np.uint64).reshape(-1, 3) for kind in range(3))
        info = np.unique(info, axis=0)  # a row for each copy of a class
        more = np.unique(more, axis=0)
        n, plain = info[:, 1].astype(np.int64), info[:, 2].astype(np.int64)
        own = np.searchsorted(info[:, 0], common[:, 0])
        alone = plain - np.bincount(own, minlength=len(info)) if len(info) else plain
        need = n - -(-percent * n // 100) + 1 - alone
        # common shingles, the rarest first, then the further ones
        owner = np.concatenate([own, np.searchsorted(info[:, 0], more[:, 0])])
        key = np.concatenate([common[:, 1], more[:, 1]])
        late = np.concatenate([np.zeros(len(common), np.int8), np.ones(len(more), np.int8)])
        order = np.lexsort((key, np.concatenate([common[:, 2], more[:, 2]]), late, owner))
        owner, key = owner[order], key[order]
        firsts = np.searchsorted(owner, np.arange(len(info)))
        taken = np.arange(len(owner)) - firsts[owner] < need[owner]
        owner, key = owner[taken], key[taken].view(np.int64)
        has, starts = np.unique(owner, return_index=True)
        keys = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)), pa.int32()), pa.array(key, pa.int64()))
        return pa.table({"cid": pa.array(info[has, 0].view(np.int64)), "n": pa.array(n[has]), "keys": keys})

    return known.groupBy("part").applyInArrow(choose, "cid long, n long, keys array<bigint>")


def needed_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """cid, vec, set of the classes whose first documents are reps.rep, built anew from their texts."""
    bit = F.pmod(F.xxhash64("rep"), F.lit(MARKS))
    want = reps.select((bit / 4096).cast("int").alias("w"), (bit % 4096).cast("int").alias("b"))

    def line(table: pa.Table) -> pa.Table:
        bits = np.zeros(4096, np.uint8)
        bits[table.column("b").to_numpy()] = 1
        return pa.table({"w": table.column("w")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    field = np.zeros((MARKS // 4096, 512), np.uint8)
    for r in want.distinct().groupBy("w").applyInArrow(line, "w int, bits binary").toLocalIterator():
        field[r.w] = np.frombuffer(r.bits, np.uint8)
    marked = docs.sparkSession.sparkContext.broadcast(field.ravel())

    def build(batches):
        bits = marked.value
        for rows in batches:
            at = rows.column("at").to_numpy()
            rows = rows.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            found = [x for x in shingle_sets(rows.column("text"), size) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in found], pa.int64()), pa.array([point(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["cid", "vec", "set"])

    hit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARKS)).alias("at")
    sets = docs.where("doc_id is not null").select(hit, "text").mapInArrow(build, "cid long, vec binary, set binary")
    return materialise(sets.dropDuplicates(["cid"]), "needed-sets")


def ties(heads: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b): each class of cid, n, keys with one class of each of its first blocks."""
    each = heads.select("cid", "n", F.explode(F.slice("keys", 1, TIED)).alias("key"))
    drawn = F.struct(F.xxhash64("key", "cid").alias("h"), F.col("cid").alias("to"), F.col("n").alias("m"))
    reps = each.groupBy("key").agg(F.min(drawn).alias("r"), F.count("*").alias("k")).where("k > 1").select("key", "r.to", "r.m")
    near = (F.col("cid") != F.col("to")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return each.join(reps, "key").where(near).select(F.least("cid", "to").alias("a"), F.greatest("cid", "to").alias("b")).distinct()


def blocks(heads: DataFrame, sets: DataFrame, group: DataFrame) -> DataFrame:
    """part, cid, keys, n, vec, group of the classes in blocks of more than one component.

    Blocks whose first class by hash is the same are one, so that blocks of about the same classes are searched once;
    keys name blocks, or pairs of tiles of a block beyond TILE classes."""
    heads = heads.join(group, "cid", "left").withColumn("group", F.coalesce("group", "cid"))
    each = heads.select("cid", "group", F.explode("keys").alias("key"))
    several = each.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min(F.xxhash64("cid")).alias("block")).where("low < high")
    places = materialise(each.join(several.select("key", "block"), "key").select("cid", "block").distinct(), "places")
    large = places.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    tile = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.xxhash64("block", F.least(tile, j), F.greatest(tile, j)))
    keys = F.when(F.col("tiles").isNull(), F.array("block")).otherwise(pairs)
    tiled = places.join(large, "block", "left").select("cid", F.explode(keys).alias("key"))
    parts = max(8, -(-places.count() // BLOCKS))
    rows = tiled.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "cid").agg(F.collect_list("key").alias("keys"))
    return rows.join(heads.select("cid", "n", "group"), "cid").join(sets.select("cid", "vec"), "cid")


def candidates(blocks: DataFrame, percent: int, turn: int) -> DataFrame:
    """From rows part, cid, keys, n, vec, group: pairs (a, b) that pass the bound, and part, cid, keys of crowded blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("cid", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        cid, n, group = (table.column(c).to_numpy() for c in ("cid", "n", "group"))
        vec = table.column("vec").to_pylist()
        key = pc.list_flatten(table.column("keys")).to_numpy()
        rows = np.repeat(np.arange(len(vec)), pc.list_value_length(table.column("keys")).to_numpy())
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.append(starts, len(key)))
        small = (lengths > 1) & (lengths <= CROWD + 1)
        ones, twos = ([x] for x in small_pairs(rows, starts[small], lengths[small], n, vec, group, percent))

        def flush() -> pa.RecordBatch:
            one, two = cid[np.concatenate(ones)], cid[np.concatenate(twos)]
            pair = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0)
            return rows_of(a=pair[:, 0], b=pair[:, 1])

        held = 0
        kept: list[np.ndarray] = []
        for a, k in zip(starts[lengths > CROWD + 1].tolist(), lengths[lengths > CROWD + 1].tolist(), strict=True):
            own = rows[a : a + k]
            crowded = False
            for i, j, cut in block_pairs(cid[own], n[own], [vec[x] for x in own], group[own], percent, turn):
                crowded |= cut
                ones.append(own[i])
                twos.append(own[j])
                held += len(i)
                if held > HELD:
                    yield flush()
                    ones, twos, held = [], [], 0
            if crowded:
                kept.append(np.arange(a, a + k))
        if ones:
            yield flush()
        rest = np.concatenate(kept) if kept else np.empty(0, np.int64)
        rest = rest[np.argsort(rows[rest], kind="stable")]
        owner, at = np.unique(rows[rest], return_index=True)
        keys = np.split(key[rest], at[1:]) if len(at) else []
        yield rows_of(part=np.full(len(owner), table.column("part")[0].as_py(), np.int32), cid=cid[owner], keys=keys)

    return blocks.groupBy("part").applyInArrow(search, "a long, b long, part int, cid long, keys array<bigint>")


def _ends(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs with the column of both ends, as x and y."""
    left = sets.select(F.col("cid").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b")


def within_bound(heads: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be at the threshold by the counts of their points."""

    @arrow_udf("boolean")
    def may(n: pa.Array, m: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        sizes = np.concatenate([n.to_numpy(), m.to_numpy()])
        i, j = np.arange(len(n)), np.arange(len(n)) + len(n)
        swap = sizes[i] > sizes[j]
        return pa.array(bounded(np.where(swap, j, i), np.where(swap, i, j), sizes, xs.to_pylist() + ys.to_pylist(), percent), pa.bool_())

    vecs = sets.join(heads.select("cid", "n"), "cid").select("cid", F.struct("n", "vec").alias("v"))
    return _ends(pairs, vecs, "v").where(may("x.n", "y.n", "x.vec", "y.vec")).select("a", "b")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are at the threshold."""

    @arrow_udf("boolean")
    def linked(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.sort(np.concatenate([x, y]))
            both = int((both[1:] == both[:-1]).sum())
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return _ends(pairs, sets, "set").where(linked("x", "y")).select("a", "b")


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, counts = marks(docs, size, percent)
    real = rows.where("doc_id is not null and cid is not null")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total * LOW * (100 - percent) / 100) // PART))
    crowd = spark.sparkContext.broadcast(crowded_order(counts))
    common = shared(postings(real, crowd, percent, parts), parts)
    known = class_sums(real, crowd, percent, parts).union(common.withColumn("kind", F.lit(2)))
    heads = materialise(opening(known, percent), "heads")
    classes = materialise(real.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    sets = needed_sets(docs, classes.join(heads.select("cid"), "cid"), size)
    links = materialise(verified(sets, within_bound(heads, sets, ties(heads, percent), percent), percent), "verified")

    def so_far() -> DataFrame:
        return materialise(components(links).select(F.col("node").alias("cid"), F.col("component").alias("group")), "groups")

    rest = blocks(heads, sets, so_far())
    for turn in itertools.count():  # ends: a turn ties more partners than any block has points at last
        found = materialise(candidates(rest, percent, turn), "candidates")
        pairs = found.where("a is not null").select("a", "b").distinct()
        links = materialise(links.union(verified(sets, pairs, percent)), "verified")
        left = found.where("a is null").select("part", "cid", "keys")
        if left.isEmpty():
            break
        whose = heads.select("cid", "n").join(so_far(), "cid", "left").withColumn("group", F.coalesce("group", "cid"))
        rest = left.join(whose, "cid").join(sets.select("cid", "vec"), "cid")
    rep = classes.select("cid", "rep")
    ends = links.join(rep.withColumnsRenamed({"cid": "a", "rep": "ra"}), "a").join(rep.withColumnsRenamed({"cid": "b", "rep": "rb"}), "b")
    # rows of one doc_id with different texts belong together
    several = real.groupBy("doc_id").agg(F.count_distinct("cid").alias("k")).where("k > 1").select("doc_id")
    same = several.join(real, "doc_id").join(rep, "cid").select("doc_id", "rep")
    found = components(ends.select("ra", "rb").union(same), "ra", "rb")
    of_class = rep.join(found, rep.rep == found.node, "left").select("cid", F.coalesce("component", "rep").alias("component"))
    # only classes with copies or links are looked up; any other row is its own component
    told = of_class.join(classes.select("cid", "copies"), "cid").join(rep, "cid").where("copies > 1 or component <> rep").select("cid", "component")
    out = rows.select("doc_id", "n", "cid").join(told, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the first of their group, with the columns they came with."""
    gone = join(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"))
    return whole.join(gone, F.col("of") == F.col("id"), "left_anti").select("row.*")
