"""The nearest names by matching-block ratio: names in sorted blocks, read by their common beginnings."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536  # names of one block
TILE = 16_384  # names asked for in one group
WIDTH = 64  # characters that bounds read; what is beyond them counts as matched
STEPS = 1 << 22  # pairs of a beginning and an asked name that are held at once


def _codes(names: list[str]) -> np.ndarray:
    """A row a name, a column a character of its beginning; 0 ends a name."""
    width = min(WIDTH, max(map(len, names), default=0)) + 1
    return np.array([n[: width - 1] for n in names], f"S{width}").view(np.uint8).reshape(len(names), width) & 127


class Beginnings:
    """Sorted distinct names of letters and digits; each depth has the runs of rows that share a beginning."""

    def __init__(self, names: list[str]):
        self.codes = _codes(names)
        self.sizes = np.array([len(n) for n in names], np.int64)
        fresh = np.ones(len(names), bool)
        self.starts, self.shortest, self.longest, same = [], [], [], np.ones(len(names) - 1, bool)
        for d in range(self.codes.shape[1]):
            same &= self.codes[1:, d] == self.codes[:-1, d]
            fresh[1:] = ~same
            at = np.flatnonzero(fresh)
            self.starts.append(at)
            self.shortest.append(np.minimum.reduceat(self.sizes, at))
            self.longest.append(np.maximum.reduceat(self.sizes, at))

    def within_reach(self, asked: list[str], floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in asked, row, bound) of all names whose ratio may reach the floor of an asked name. Matching blocks are
        a common subsequence, so its longest length bounds the ratio; it is carried on from beginning to beginning, a bit
        a character of the asked name, and a beginning is left as soon as no name can reach the floor from it on."""
        size = np.array([len(a) for a in asked], np.int64)
        chars = _codes(asked)
        read = np.minimum(size, WIDTH)
        masks = np.zeros((len(asked), 128), np.uint64)
        for i in range(chars.shape[1] - 1):
            here = np.flatnonzero(chars[:, i])
            masks[here, chars[here, i]] |= np.uint64(1 << i)
        full = np.where(read < WIDTH, (np.uint64(1) << read.astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        q, row, at = np.arange(len(asked)), full.copy(), None
        rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for d in range(self.codes.shape[1]):
            starts = self.starts[d]
            if d:
                before = self.starts[d - 1]
                first = np.searchsorted(starts, before)
                count = np.append(first[1:], len(starts))[at] - first[at]
                base = first[at]
            else:
                count, base = np.full(len(q), len(starts)), np.zeros(len(q), np.int64)
            q, row = np.repeat(q, count), np.repeat(row, count)
            at = np.repeat(base - np.cumsum(count) + count, count) + np.arange(count.sum())
            char = self.codes[starts[at], d]
            met = row & masks[q, char]  # an ending meets nothing
            row = (row + met) | (row - met)
            common = read[q] - np.bitwise_count(row & full[q]) + (size - read)[q]
            ended, depth = char == 0, np.minimum(d + 1, WIDTH)
            bound = self._bound(common, depth, size[q], self.shortest[d][at], self.longest[d][at])
            if d == WIDTH:  # beginnings of long names; those that go on alike are told apart by their sizes
                ended[:] = True
            good = np.where(ended, True, bound >= floors[q] - 1e-9)
            done = np.flatnonzero(ended)
            if len(done):
                ends = np.append(starts[1:], len(self.sizes))[at[done]]
                many = ends - starts[at[done]]
                r = np.repeat(starts[at[done]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                p, c = np.repeat(q[done], many), np.repeat(common[done], many)
                # of a name that has ended all characters are read
                b = self._bound(c, np.minimum(self.sizes[r], WIDTH), size[p], self.sizes[r], self.sizes[r])
                kept = b >= floors[p] - 1e-9
                rows.append((p[kept], r[kept], b[kept]))
            on = np.flatnonzero(good & ~ended)
            q, row, at = q[on], row[on], at[on]
        return tuple(map(np.concatenate, zip(*rows, strict=True)))

    @staticmethod
    def _bound(common, depth, size, shortest, longest):
        """The highest ratio of names of the given sizes when common characters are met in the first depth."""
        n = np.clip(size - common + depth, shortest, longest)
        length = size + n
        return np.where(length > 0, 2.0 * np.minimum(size, common + n - depth) / np.maximum(length, 1), 1.0)


def best_of_block(asked: list[str], floors: np.ndarray, known: pd.DataFrame, k: int, least: float):
    """(asked name, account, ratio): the k best rows (name, account) of known for each asked name, from least on. Names
    are compared from the highest bound on, until none left can come before the k-th."""
    rows = known.sort_values(["name", "account"])
    accounts, names = rows["account"].tolist(), rows["name"].tolist()
    fresh = [i for i, n in enumerate(names) if not i or n != names[i - 1]]
    ends = [*fresh[1:], len(names)]
    tree = Beginnings([names[i] for i in fresh])
    at_once = max(1, STEPS // len(fresh))
    order = rows["account"].rank(method="min").to_numpy()[fresh]
    matcher = SequenceMatcher(None)
    for begin in range(0, len(asked), at_once):
        part = asked[begin : begin + at_once]
        q, found, bound = tree.within_reach(part, floors[begin : begin + at_once])
        by = np.lexsort((order[found], -bound, q))
        best, last = [], None
        for i, r, b in zip(q[by].tolist(), found[by].tolist(), bound[by].tolist(), strict=True):
            if i != last:
                yield from ((part[last], a, -s) for s, a in best)
                best, last = [], i
            if len(best) == k and (-b, accounts[fresh[r]]) > best[-1]:
                continue
            x, y = part[i], names[fresh[r]]
            matcher.set_seqs(x, y)
            s = 1.0 if x == y else matcher.ratio()
            if s >= least:
                best = sorted([*best, *((-s, a) for a in accounts[fresh[r] : ends[r]])])[:k]
        yield from ((part[last], a, -s) for s, a in best)


def nearest_names(asked: DataFrame, known: DataFrame, k: int, least: float) -> DataFrame:
    """name, account, ratio: of each block of known (name, account) the k rows likest to an asked name, from least on; at
    a tie the smaller account. asked: name and floor, a ratio that the k-th best of all blocks reaches. Names are ASCII.

    Known names stand in ranges of BLOCK, asked ones in tiles: a group holds one of each, whatever the number of names."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = known.count(), asked.count()
    blocks, tiles = max(1, min(parts, n // 1024), -(-n // BLOCK)), max(1, -(-m // TILE))
    left = known.repartitionByRange(blocks, "name").withColumn("_block", F.spark_partition_id())
    left = left.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = asked.withColumn("_tile", F.pmod(F.xxhash64("name"), F.lit(tiles)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind, total = known.schema["account"].dataType.simpleString(), max(parts, blocks * tiles)

    def met(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = best_of_block(asked["name"].tolist(), asked["floor"].to_numpy(), known, k, least) if len(known) and len(asked) else ()
        return pd.DataFrame(list(found), columns=["name", "account", "ratio"])

    left, right = (d.repartition(total, "_block", "_tile").groupBy("_block", "_tile") for d in (left, right))
    return left.cogroup(right).applyInPandas(met, f"name string, account {kind}, ratio double")
