"""Hard-negative mining with exact integer scores by the method of the Four Russians.

Candidates are packed by bits: the vectors of a block are whole numbers in two's complement, and each bit of eight
dimensions is one byte (a bit plane). For an anchor and a group of eight dimensions a table holds the sums of all 256
subsets of its components; a plane's byte is the index, and planes are added from the highest on, doubling in between
(the highest is the sign and is taken away). That gives the full inner product.

Rows are dealt in ranges of the label, so that a block holds few labels. Blocks of anchors meet blocks of candidates in
tiles of bounded size, each in a task of its own: first those that share a label, for the positives, then all, for the
negatives within the bounds that the positives set. A task keeps the best rows of each anchor and nothing else. Anchors
take turns, a bounded number of blocks at a time, so that the copies of candidates on disk stay a fixed multiple of the
input.

A row takes no part if its vec_id, label or vector is null, or if a component is null or not finite. Vectors of
different lengths are compared as if the shorter had zeros at its end; an empty one scores zero. A scaled component beyond
2 ** 31 / sqrt(dimensions) is held at that bound, so that no sum leaves 64 bits.
Rows that share a vec_id are rows of their own, anchors too: an anchor leaves out itself alone. Among rows of equal score
and vec_id either may stand. An empty table gives no rows; columns beside vec_id, embedding and label play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, small_batches

#: Candidates and anchors in a block, blocks of candidates in a tile, blocks of anchors in a turn.
CANDIDATES, ANCHORS, TILE, TURN = 4096, 512, 4, 16
#: Dimensions of a table of subset sums; candidates that are scored side by side.
GROUP, BESIDE = 8, 256
BLOCK = "block int, labels array<long>, n int, dims int, planes int, ids binary, label binary, node binary, bits binary"


def planes_of(q: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of bit planes of whole-numbered rows, and their bytes as (plane, group, row)."""
    rows, dims = q.shape
    top = max(int(q.max(initial=0)), -int(q.min(initial=0)) - 1, 0)
    planes, groups = top.bit_length() + 1, -(-dims // GROUP)
    wide = np.zeros((rows, groups * GROUP), np.int64)
    wide[:, :dims] = q
    bits = np.empty((planes, groups, rows), np.uint8)
    for b in range(planes):
        bits[b] = np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little").T
    return planes, bits


def subset_sums(anchors: np.ndarray, groups: int, planes: int) -> tuple[np.ndarray, type]:
    """Tables (group, subset, anchor) of an anchor block, in the narrowest numbers that hold a plane's sum; and the
    numbers that hold the whole score."""
    wide = np.zeros((groups * GROUP, len(anchors)), np.int64)
    used = anchors[:, : groups * GROUP]
    wide[: used.shape[1]] = used.T
    most = int(np.abs(wide).max(initial=0)) * groups * GROUP
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    sums = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    for k in range(GROUP):
        sums[:, 1 << k : 2 << k] = sums[:, : 1 << k] + wide[k::GROUP][:, None].astype(kind)
    return sums, np.int32 if most << planes < 1 << 31 else np.int64


def scores(sums: np.ndarray, kind: type, bits: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor): a lookup for each plane and group, planes doubled and added from the sign on."""
    planes, groups, rows = bits.shape
    total = np.zeros((rows, sums.shape[2]), kind)
    plane, looked = np.empty(total.shape, sums.dtype), np.empty(total.shape, sums.dtype)
    for b in range(planes - 1, -1, -1):
        plane[:] = 0
        for g in range(groups):
            np.take(sums[g], bits[b, g].astype(np.intp), axis=0, out=looked, mode="clip")
            plane += looked
        total += total
        if b == planes - 1:
            total -= plane
        else:
            total += plane
    return total


def pack(batches):
    """One block for each CANDIDATES rows of a partition, rows sorted by label and vec_id."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).sort_by([("label", "ascending"), ("vec_id", "ascending")])
    for at in range(0, table.num_rows, CANDIDATES):
        part = table.slice(at, CANDIDATES)
        q = matrix(part.column("q"))
        planes, bits = planes_of(q)
        ids, label, node = (part.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label", "node"))
        row = {"block": part.column("block")[0].as_py(), "labels": np.unique(label).tolist(), "n": len(ids), "dims": q.shape[1], "planes": planes, "ids": ids.tobytes(), "label": label.tobytes(), "node": node.tobytes(), "bits": bits.tobytes()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int32()), ("labels", pa.list_(pa.int64())), ("n", pa.int32()), ("dims", pa.int32()), ("planes", pa.int32()), *((c, pa.binary()) for c in ("ids", "label", "node", "bits"))]))


def matrix(column) -> np.ndarray:
    """Rows of whole numbers as one array; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(1, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    return out


class Best:
    """The first k rows of each of many queries by score from the highest on and vec_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, np.iinfo(np.int64).min)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score.astype(np.int64)), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.least[query[full]] = score[full]


def tile(anchors: pa.Table, blocks: pa.Table, k: int, mine) -> Best | None:
    """The best rows of each query over all blocks of a tile. mine tells which labels an anchor wants, and gives the
    masks (candidate, anchor) of each of its queries from the scores, that, the candidates' nodes and the least scores
    that still count."""
    if not anchors.num_rows or not blocks.num_rows:
        return None
    q, best, made = matrix(anchors.column("q")), Best(anchors.num_rows * mine.queries, k), {}
    for row in blocks.to_pylist():
        groups, n = -(-row["dims"] // GROUP), row["n"]
        shape = groups, row["planes"]
        if shape not in made:
            made = {shape: subset_sums(q, *shape)}
        bits = np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], groups, n)
        ids, label, node = (np.frombuffer(row[c], np.int64) for c in ("ids", "label", "node"))
        for at in range(0, n, BESIDE):
            part = slice(at, min(at + BESIDE, n))
            wanted = mine.wanted(label[part])
            if not wanted.any():
                continue
            found = scores(*made[shape], np.ascontiguousarray(bits[:, :, part]))
            for j, mask in mine(found, wanted, node[part], best.least):
                c, a = np.nonzero(mask)
                if len(c):
                    best.add(a * mine.queries + j, found[c, a], ids[part][c])
    return best


def as_narrow(bounds: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Bounds as numbers of the scores' kind, whose ends no score reaches: comparing like numbers is far quicker."""
    ends = np.iinfo(found.dtype)
    return np.clip(bounds, ends.min, ends.max).astype(found.dtype)


class Positives:
    """Other rows of the anchor's label."""

    queries = 1

    def __init__(self, anchors: pa.Table):
        self.label, self.node = (anchors.column(c).to_numpy().astype(np.int64) for c in ("label", "node"))

    def wanted(self, label):
        return label[:, None] == self.label

    def __call__(self, found, wanted, node, least):
        yield 0, wanted & (node[:, None] != self.node) & (found >= as_narrow(least, found))


class Negatives:
    """Rows of other labels whose score lies within the bounds that a positive sets, for each positive of an anchor."""

    def __init__(self, anchors: pa.Table, floor: int):
        self.label = anchors.column("label").to_numpy().astype(np.int64)
        scores = anchors.column("positives").to_pylist()
        self.queries = max(map(len, scores), default=0)
        high = np.full((len(scores), self.queries), np.iinfo(np.int64).min)
        for a, found in enumerate(scores):
            high[a, : len(found)] = found
        self.high = high
        # the smallest whole number from floor percent of the positive on; none where there is no positive
        low = np.array([[-(-floor * int(x) // 100) for x in row] for row in high.tolist()], object).reshape(high.shape)
        self.low = np.where(high == np.iinfo(np.int64).min, np.iinfo(np.int64).max, low).astype(np.int64)

    def wanted(self, label):
        return label[:, None] != self.label

    def __call__(self, found, wanted, node, least):
        for j in range(self.queries):
            low = np.maximum(self.low[:, j], least[j :: self.queries])
            yield j, wanted & (found <= as_narrow(self.high[:, j], found)) & (found >= as_narrow(low, found))


def first_positives(anchors: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    best = tile(anchors, blocks, k, Positives(anchors))
    none = np.zeros(0, np.int64)
    query, score, ids = (best.query, best.score, best.id) if best else (none, none, none)
    return pa.table({"node": anchors.column("node").to_numpy()[query], "id": ids, "score": score})


def first_negatives(anchors: pa.Table, blocks: pa.Table, k: int, floor: int) -> pa.Table:
    mine = Negatives(anchors, floor)
    best = tile(anchors, blocks, k, mine) if mine.queries else None
    none = np.zeros(0, np.int64)
    query, score, ids = (best.query, best.score, best.id) if best else (none, none, none)
    own = query // max(1, mine.queries)
    return pa.table({"node": anchors.column("node").to_numpy()[own], "place": pa.array(query % max(1, mine.queries), pa.int32()), "id": ids, "score": score})


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q (whole numbers of the scaled components), node (a number of the row) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    bound = F.floor(2.0**31 / F.sqrt(F.size("v"))).cast("double")
    held = F.transform("v", lambda x: F.greatest(F.least(F.floor(scale * x).cast("double"), bound), -bound).cast("long"))
    return rows.select("vec_id", "label", held.alias("q"), F.monotonically_increasing_id().alias("node"))


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """rows with the number of their block: ranges of the label, of about size rows each; a label's rows spread by their
    own numbers over as many blocks as they need."""
    many = max(1, -(-rows.count() // size))
    return rows.repartitionByRange(many, "label", "node").withColumn("block", F.spark_partition_id())


def mine(vectors: DataFrame, scale: int = 256, every: int = 100, k: int = 5, floor: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first k rows of other labels for each
    anchor (vec_id divisible by every) and each of its first k positives, with a score of floor to 100 percent of the
    positive's."""
    spark = vectors.sparkSession
    small_batches(spark, CANDIDATES)
    rows = materialise(whole_numbers(vectors, scale), "numbers")
    blocks = materialise(blocks_of(rows, CANDIDATES).mapInArrow(pack, BLOCK), "blocks")
    anchors = materialise(blocks_of(rows.where(F.col("vec_id") % every == 0), ANCHORS), "anchors")
    last, last_block = (t.agg(F.max("block")).first()[0] for t in (anchors, blocks))
    blocks = blocks.withColumn("part", F.col("block").bitwiseAND(-TILE))
    turns = [range(t, min(t + TURN, last + 1)) for t in range(0, last + 1, TURN)] if last is not None else []
    found = [turn(anchors.where(F.col("block").between(t.start, t.stop - 1)), blocks, t, last_block, k, floor) for t in turns]
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def dealt(rows: DataFrame) -> GroupedData:
    """rows by tile: the block of anchors and the part of the blocks of candidates. All columns become new ones, as both
    sides of a tile come from the same tables."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns)).groupBy("block", "part")


def turn(anchors: DataFrame, blocks: DataFrame, numbers: range, last: int, k: int, floor: int) -> DataFrame:
    """mine() for the anchors of a few blocks (their numbers), written to the shared folder."""
    # the positives: tiles of blocks that share a label
    labelled = blocks.select(F.col("block").alias("other"), "part", F.explode("labels").alias("label"))
    pairs = anchors.select("block", "label").distinct().join(labelled, "label").select("block", "other", "part").distinct()
    left = dealt(anchors.join(pairs.select("block", "part").distinct(), "block"))
    right = dealt(blocks.drop("part").withColumnRenamed("block", "other").join(pairs, "other"))
    near = left.cogroup(right).applyInArrow(lambda a, b: first_positives(a, b, k), "node long, id long, score long")
    order = W.partitionBy("node").orderBy(F.col("score").desc(), "id")
    near = materialise(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k), "positives")
    # the negatives: all tiles
    bounds = near.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("positives"))
    asked = anchors.join(bounds, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(TILE))))
    all_blocks = blocks.withColumn("block", F.explode(F.array(*map(F.lit, numbers))))
    far = dealt(asked).cogroup(dealt(all_blocks)).applyInArrow(lambda a, b: first_negatives(a, b, k, floor), "node long, place int, id long, score long")
    order = W.partitionBy("node", "place").orderBy(F.col("score").desc(), "id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = near.select("node", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("node", F.col("vec_id").alias("anchor_id")), "node")
    out = far.select("node", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["node", "place"])
    return materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
