"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are compared within a label (and a dimension), which is split into shards of bounded size by a hash of the id.
Each shard builds one graph, written to the shared folder; every vector queries every shard of its label, shard pair by
shard pair. A beam that comes back full of links floods on along the links' neighbours; a sample of queries is
audited against a full scan of the shard, and the beam is doubled until the audit passes (beyond WIDEST the scan itself
answers). Links are verified by cosine in double precision. A task returns one row for each vector, its number of links
and the smallest vector joined to it there, never the pairs; components are joined up over these rows.

Vectors that are null, zero or hold null or non-finite components, and those without label, link with nothing. Vectors
of different lengths are not compared. Rows that share a vec_id are vectors of their own: each comes back, and they link
with each other as any two do. A row with a null vec_id comes back with no links. An empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, materialise

LEAST = 0.98
#: Vectors in a shard; the boolean table of a shard pair's links then takes at most 64 MB.
SHARD = 8192
#: Neighbours kept for a vector (twice as many on the ground layer), the beam of building, the first and the widest beam of queries.
NEIGHBOURS, BUILD_BEAM, FIRST_BEAM, WIDEST = 12, 40, 16, 512
#: Queries of each shard pair that are audited: as many as hold so many links to other vectors, but at most so many; and
#: the recall that they must reach. Where hardly a link is met, the beam starts wide.
LINKS, AUDITED, RECALL, UNSURE = 64, 1024, 0.995, 64


class Graph:
    """A navigable small-world graph over unit vectors; layers thin out by powers of NEIGHBOURS."""

    def __init__(self, vectors: np.ndarray):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        heights = np.minimum((-np.log(np.random.default_rng(7).random(n) + 1e-12) / np.log(NEIGHBOURS)).astype(int), 8)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(heights.max()) + 1)]
        self.top = -1
        for i in range(n):
            self._insert(i, int(heights[i]))

    def _beam(self, q: np.ndarray, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The best points met in the layer as (similarity, point), from the worst on."""
        links, v = self.layers[layer], self.v
        seen = set(starts)
        todo = [(-float(v[s] @ q), s) for s in starts]
        best = [(-d, s) for d, s in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) >= width and -d < best[0][0]:
                break
            new = [x for x in links[c] if x not in seen]
            if not new:
                continue
            seen.update(new)
            for s, x in zip((v[new] @ q).tolist(), new, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, x))
                    heapq.heappush(todo, (-s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                    heapq.heappush(todo, (-s, x))
        best.sort()
        return best

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near points in different directions first, then the nearest of the rest."""
        if len(found) <= most:
            return [x for _, x in found]
        names = [x for _, x in reversed(found)]
        near = [s for s, _ in reversed(found)]
        between = self.v[names] @ self.v[names].T
        taken, rest = [], []
        for k in range(len(names)):
            if len(taken) < most and (not taken or between[k, taken].max() < near[k]):
                taken.append(k)
            else:
                rest.append(k)
        return [names[k] for k in (taken + rest)[:most]]

    def _insert(self, i: int, height: int) -> None:
        q = self.v[i]
        if self.top < 0:
            self.start = i
        else:
            at = [self.start]
            for layer in range(self.top, height, -1):
                at = [self._beam(q, at, 1, layer)[-1][1]]
            for layer in range(min(height, self.top), -1, -1):
                found = self._beam(q, at, BUILD_BEAM, layer)
                most = NEIGHBOURS * (2 - bool(layer))
                links = self.layers[layer]
                links[i] = self._choose(found, NEIGHBOURS)
                for x in links[i]:
                    own = links[x]
                    own.append(i)
                    if len(own) > most + 8:  # now and then, not for each link
                        near = (self.v[own] @ self.v[x]).tolist()
                        links[x] = self._choose(sorted(zip(near, own, strict=True)), most)
                at = [x for _, x in found]
        if height > self.top:
            for layer in range(self.top + 1, height + 1):
                self.layers[layer][i] = []
            self.top, self.start = height, i

    def links(self, q: np.ndarray, width: int, least: float) -> np.ndarray:
        """Points of at least this similarity, as far as a beam of this width and a flood along the links find them."""
        at = [self.start]
        for layer in range(self.top, 0, -1):
            at = [self._beam(q, at, 1, layer)[-1][1]]
        hits = [x for s, x in self._beam(q, at, width, 0) if s >= least]
        if len(hits) < width // 2:
            return np.array(hits, np.int64)
        ground, seen, edge = self.layers[0], set(hits), hits
        while edge:
            new = list({y for x in edge for y in ground[x]} - seen)
            if not new:
                break
            edge = [x for x, s in zip(new, (self.v[new] @ q).tolist(), strict=True) if s >= least]
            seen.update(edge)
        return np.fromiter(seen, np.int64, len(seen))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def audited(points: np.ndarray, target: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sampled queries and their true links by a full scan, without those of a vector to itself."""
    order, truth, met = np.random.default_rng(11).permutation(len(points)), [], 0
    for a in range(0, min(AUDITED, len(order)), 64):
        own = order[a : min(a + 64, AUDITED)]
        links = points[own] @ target.T >= least
        if points is target:
            links[np.arange(len(own)), own] = False
        truth.append(links)
        met += int(links.sum())
        if met >= LINKS:
            break
    return order[: sum(map(len, truth))], np.concatenate(truth)


def recall(found: np.ndarray, truth: np.ndarray) -> float:
    """The share of true links that were found; 1 if there are none."""
    return float((found & truth).sum() / truth.sum()) if truth.any() else 1.0


def search(points: np.ndarray, graph: Graph, target: np.ndarray, least: float) -> np.ndarray:
    """Boolean table of the links of points to the vectors of a graph, verified in double precision."""
    loose = least - 1e-4  # of single precision; what is found is verified
    queries = points.astype(np.float32)
    found = np.zeros((len(points), len(target)), bool)
    audit, truth = audited(points, target, least)
    width = FIRST_BEAM if truth.sum() >= LINKS else UNSURE
    while width <= WIDEST:
        for i in audit:
            found[i, graph.links(queries[i], width, loose)] = True
        if recall(found[audit], truth) >= RECALL:
            break
        width *= 2
    for a in range(0, len(points), 256):
        rows = slice(a, a + 256)
        if width > WIDEST:  # the audit never passed: the scan answers
            found[rows] = points[rows] @ target.T >= least
            continue
        for i in range(a, min(a + 256, len(points))):
            found[i, graph.links(queries[i], width, loose)] = True
        i, j = np.nonzero(found[rows])
        found[rows][i, j] = (points[a + i] * target[j]).sum(1) >= least
    return found


def smallest_joined(found: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links the first row that links reach."""
    lab = np.arange(len(found))
    some = np.flatnonzero(found.any(1))
    while len(some):
        new = lab.copy()
        for i in some:
            new[i] = min(lab[i], lab[found[i]].min())
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def build(table: pa.Table) -> pa.Table:
    """The shard's graph with its nodes and vectors, as one row."""
    order = np.argsort(table.column("node").to_numpy())
    ids = table.column("node").to_numpy()[order]
    flat = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64)
    vectors = unit(flat.reshape(len(ids), -1)[order])
    graph = Graph(vectors)
    blob = pickle.dumps((ids, vectors, graph), protocol=5)
    return pa.table({c: table.column(c)[:1] for c in ("label", "dim", "shard")} | {"blob": pa.array([blob], pa.binary())})


def compare(table: pa.Table, least: float) -> pa.Table:
    """One row for each vector of a shard pair: node, its links here, the smallest node joined to it here."""
    row = table.to_pylist()[0]
    ids, vectors, graph = pickle.loads(row["blob"])
    if row["shard"] == row["other"]:
        found = search(vectors, graph, vectors, least)
        np.fill_diagonal(found, False)
        found |= found.T
        n, root = found.sum(1), ids[smallest_joined(found)]
    else:
        ids2, vectors2, graph2 = pickle.loads(row["blob2"])
        found = search(vectors, graph2, vectors2, least) | search(vectors2, graph, vectors, least).T
        n = np.concatenate((found.sum(1), found.sum(0)))
        ids = np.concatenate((ids, ids2))
        # each column is tied to its first row, and each row to its first column: that joins all that is linked
        row_to, col_to = found.argmax(1) + len(vectors), found.argmax(0)
        lab = np.arange(len(ids))
        own = np.concatenate((np.where(found.any(1), row_to, np.arange(len(vectors))), np.where(found.any(0), col_to, len(vectors) + np.arange(len(vectors2)))))
        while True:
            low = lab.copy()
            for k in np.flatnonzero(found.any(1)):
                cols = np.flatnonzero(found[k]) + len(vectors)
                m = min(low[k], low[cols].min(), low[own[k]])
                low[k], low[cols] = m, np.minimum(low[cols], m)
            if (low == lab).all():
                break
            lab = low
        root = ids[lab]
    return pa.table({"node": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(root, pa.int64())})


def links(vectors: DataFrame, least: float = LEAST, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    # written once, so that the numbers of rows stay: rows that share a vec_id are told apart by them
    rows = materialise(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")
    named = rows.where("vec_id is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = named.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))
    sizes = good.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    good = good.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int")).drop("shards", "vec_id")
    kind = good.schema["label"].dataType.simpleString()
    graphs = materialise(good.groupBy("label", "dim", "shard").applyInArrow(build, f"label {kind}, dim int, shard int, blob binary"), "graphs")
    other = graphs.withColumnsRenamed({"shard": "other", "blob": "blob2"})
    pairs = graphs.join(other, ["label", "dim"]).where("shard <= other")
    # a graph meets itself without a second copy
    pairs = pairs.withColumn("blob2", F.when(F.col("shard") < F.col("other"), F.col("blob2")))
    found = pairs.groupBy("label", "dim", "shard", "other").applyInArrow(lambda t: compare(t, least), "node long, n long, root long")
    found = materialise(found, "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.where("root <> node"), "node", "root")
    names = rows.select("node", "vec_id")
    first = joined.join(names, "node").groupBy("component").agg(F.min("vec_id").alias("first"))
    component = joined.join(first, "component").select("node", "first")
    out = names.join(counts, "node", "left").join(component, "node", "left")
    first = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"), F.coalesce(F.col("vec_id") == first, F.lit(True)).alias("kept"))
