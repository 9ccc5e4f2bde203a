"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Pieces of documents are range-sorted by length and get a distributed rank within their length. Gaps are kept as sorted
runs of sequences with equal room, so a round's state has as many entries as there are lengths and runs, which depends
on the capacity and not on the number of documents. In each round every sequence takes one piece at most: a successor
sweep gives the pieces of each length, the longest first, the smallest gaps that hold them; of pieces of equal length
the lower rank goes first; then gaps are updated, and the next round begins. Lengths come in classes (halves of the
capacity, quarters, ...), as best-fit decreasing takes them; where nothing fits, new sequences are opened.

A null text is empty: a piece with the end token alone. Repeated rows and ids are packed one by one, pieces of one
length in an order that their hash and id decide. Texts may be of any length; those with a very long run of one kind
of character are encoded by this library's own BPE. An empty table gives no rows, and columns beside doc_id and text
play no part.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from corpusloom.llm import bpe
from corpusloom.llm.bpe import BYTE_PATTERN, byte_letters
from corpusloom.llm.common import materialise, ranked

CAPACITY, END = 1024, 2
#: Half the length of a run of one kind of character on which tiktoken gives up, or takes the square of its length.
HALF_RUN = 2048
KIND = regex.compile(r"\s+|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


def long_run(text: str) -> bool:
    """Whether there is a run of two halves: then one of the text's pieces of half its length is of one kind."""
    return any(KIND.fullmatch(text, i, i + 16) and KIND.fullmatch(text, i, i + HALF_RUN) for i in range(0, len(text) - HALF_RUN + 1, HALF_RUN))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a byte-level file, in the library that reads such vocabularies fastest."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special), set(special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text."""
    coder, special = tokenizer(path)
    if text and long_run(text):
        return np.frombuffer(bpe.load(path).encode_bytes(text), np.int32).astype(np.uint32)
    return np.asarray(coder.encode_to_numpy(text or "", allowed_special=special, disallowed_special=()), np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece: a document's ids and the end token, cut from the
    back into pieces of the capacity, so that only the first may be shorter."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(batches):
        for rows in batches:
            which: list[int] = []
            out: dict[str, list] = {n: [] for n, _ in fields}
            for k, text in enumerate(rows.column("text").to_pylist()):
                ids = np.append(token_ids(text, path), np.uint32(end)).astype("<u4")
                at, n = 0, len(ids)
                while at < n:
                    size = (n - at) % capacity or capacity
                    part = ids[at : at + size]
                    which.append(k)
                    for name, v in zip(out, (len(out["piece"]), at, size, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        out[name].append(v)
                    out["piece"][-1] = at // capacity + bool(at % capacity)
                    at += size
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(out[n], t) for n, t in fields)], ["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def sweep(counts: dict[int, int], gaps: dict[int, list[tuple[int, int]]], order: list[int]) -> list[tuple[int, int, int, int]]:
    """One round: (length, gap, first sequence, count) of the matches. counts: pieces left of each length; gaps: runs
    (first sequence, count) by room; order: the rooms, ascending. Both are updated; each sequence takes part once."""
    matches, moved = [], []
    for length in sorted(counts, reverse=True):
        at = bisect_left(order, length)
        while counts[length] and at < len(order):
            room = order[at]
            runs = gaps[room]
            while runs and counts[length]:
                first, n = runs.pop()
                take = min(n, counts[length])
                if take < n:
                    runs.append((first + take, n - take))
                matches.append((length, room, first, take))
                moved.append((room - length, first, take))
                counts[length] -= take
            if runs:
                break
            del gaps[room]
            order.pop(at)
    for room, first, n in moved:
        if room:
            if room not in gaps:
                gaps[room] = []
                insort(order, room)
            gaps[room].append((first, n))
    return matches


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of each match of the rounds."""
    out, ranks = [], dict.fromkeys(lengths, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened, high = 0, capacity
    while high:
        low = high // 2
        counts = {x: n for x, n in lengths.items() if low < x <= high and n}
        while any(counts.values()):
            found = sweep(counts, gaps, order)
            for length, room, first, n in found:
                out.append((length, ranks[length], n, first, capacity - room))
                ranks[length] += n
            counts = {x: n for x, n in counts.items() if n}
            if counts and not found:  # nothing fits: open as many sequences as these pieces fill at least
                need = -(-sum(x * n for x, n in counts.items()) // capacity)
                if capacity not in gaps:
                    gaps[capacity] = []
                    insort(order, capacity)
                gaps[capacity].append((opened, need))
                opened += need
        high = low
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place, without holes in a sequence."""
    return place(materialise(pieces(docs, path, capacity, end), "pieces"), capacity)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with doc_id, piece and length (1 to capacity)."""
    lengths = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    below, total = {}, 0
    for x in sorted(lengths):
        below[x], total = total, total + lengths[x]
    rows = sorted((below[length] + rank, n, first, offset) for length, rank, n, first, offset in plan(lengths, capacity))
    starts, firsts, offsets = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3))

    @arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def placed(pos: pa.Array) -> pa.Array:
        p = pos.to_numpy(zero_copy_only=False)
        k = np.searchsorted(starts, p, "right") - 1
        return pa.StructArray.from_arrays([pa.array(firsts[k] + p - starts[k]), pa.array(offsets[k])], ["sequence_id", "offset"])

    mixed = parts.withColumn("_mix", F.xxhash64("doc_id", "piece"))
    at = ranked(mixed, ["length", "_mix", "doc_id", "piece"], "_pos", "packing").withColumn("_at", placed(F.col("_pos")))
    return at.select(*parts.columns, "_at.sequence_id", "_at.offset")
