"""Fill-in-middle transformation of whole texts by a learned index over the ranks of their line ends.

An index of a text maps the rank of a boundary (0 before the first line, k after the k-th) to its offset in code points.
It holds straight segments, fitted so that none is off by more than a fixed number of code points, and one byte a
boundary for what the segment misses. A cut is predicted by its segment and corrected by its byte, so it is exact. The
segments are fitted in Arrow batches; cuts, outputs and the way back are column expressions.

A null or empty text has no lines and stays as it is (form plain, empty output), as does a text that holds one of the
marks. A null doc_id draws its cuts as an empty one does. Texts and lines may be of any length, repeated rows come back
row by row, an empty table gives no rows, and columns beside doc_id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A segment misses no boundary by more than OFF code points; slopes are multiples of 2 ** -SCALE, and a segment has at
#: most 2 ** SCALE boundaries, so rounding a slope moves a prediction by at most one more. What is missed fits in a byte.
OFF, SCALE = 120, 16
INDEX = "struct<n:bigint,starts:array<bigint>,bases:array<bigint>,slopes:array<bigint>,missed:binary>"


def boundaries(utf8: np.ndarray) -> np.ndarray:
    """Offsets in code points of all line boundaries of a text, given as its bytes: 0 first, the text's length last."""
    if not len(utf8):
        return np.zeros(1, np.int64)
    starts = np.append(0, np.flatnonzero(utf8 == 10) + 1)
    starts = starts[starts < len(utf8)]
    return np.append(0, np.cumsum(np.add.reduceat((utf8 & 0xC0) != 0x80, starts, dtype=np.int64)))


def segments(offsets: np.ndarray, off: int = OFF) -> tuple[list[int], list[int], list[int]]:
    """First rank, offset there and slope of each segment. From a segment's first boundary the slopes that keep all
    boundaries so far within off narrow to a cone; the segment ends where the cone closes."""
    starts, bases, slopes, at = [], [], [], 0
    while at < len(offsets):
        base, low, high, seen, width = int(offsets[at]), -np.inf, np.inf, 0, 32
        while at + seen + 1 < len(offsets) and seen < 1 << SCALE:
            rise = offsets[at + seen + 1 : at + min(seen + width, 1 << SCALE) + 1] - base
            run = np.arange(seen + 1, seen + len(rise) + 1)
            lows = np.maximum(np.maximum.accumulate((rise - off) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + off) / run), high)
            good = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(rise)
            if good:
                low, high, seen = float(lows[good - 1]), float(highs[good - 1]), seen + good
            if good < len(rise):
                break
            width *= 4
        starts.append(at)
        bases.append(base)
        slopes.append(int(np.floor((low + high) / 2 * (1 << SCALE))) if seen else 0)
        at += seen + 1
    return starts, bases, slopes


def missed(offsets: np.ndarray, starts: list[int], bases: list[int], slopes: list[int]) -> bytes:
    """What the segments miss at each boundary, plus 128, a byte each."""
    ranks = np.arange(len(offsets))
    own = np.searchsorted(starts, ranks, "right") - 1
    told = np.array(bases)[own] + ((ranks - np.array(starts)[own]) * np.array(slopes)[own] >> SCALE)
    gap = offsets - told + 128
    if gap.min() < 0 or gap.max() > 255:
        raise ArithmeticError("a segment misses a boundary by more than a byte holds")
    return gap.astype(np.uint8).tobytes()


def indexed(texts: pa.Array) -> pa.Array:
    """The index of each whole text; n is its number of lines."""
    out = []
    for text in texts:
        raw = text.as_buffer() if text.is_valid else None
        offsets = boundaries(np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8))
        found = segments(offsets)
        out.append(dict(zip(("n", "starts", "bases", "slopes", "missed"), (len(offsets) - 1, *found, missed(offsets, *found)), strict=True)))
    whole, parts = pa.list_(pa.int64()), ("starts", "bases", "slopes")
    return pa.array(out, pa.struct([("n", pa.int64()), *((x, whole) for x in parts), ("missed", pa.binary())]))


def index(text: Column) -> Column:
    """The index of each whole text, a struct of INDEX."""

    @arrow_udf(INDEX)
    def index_of(texts: pa.Array) -> pa.Array:
        return indexed(texts)

    return index_of(text)


def cut_at(found: Column, rank: Column) -> Column:
    """The offset of the boundary of that rank: its segment's prediction, corrected by the stored byte."""
    own = F.size(F.filter(found["starts"], lambda s: s <= rank))
    told = F.element_at(found["bases"], own) + F.shiftright((rank - F.element_at(found["starts"], own)) * F.element_at(found["slopes"], own), SCALE)
    byte = F.conv(F.hex(F.substring(found["missed"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return told + byte - 128


def piece(text: Column, start: Column, end: Column | None = None) -> Column:
    """Code points of text from start (0 first) to end, or to its end."""
    return F.substr(text, (start + 1).cast("int"), *([] if end is None else [(end - start).cast("int")]))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, text (null: empty), n lines, form, the parts prefix, middle and suffix (null if plain), output.

    Draws are made from the hash of seed and doc_id: rate percent of the texts are transformed, spm percent of these with
    the suffix first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("*", index(F.col("text")).alias("index"), *(h.alias(f"h{i}") for i, h in enumerate(drawn, 1)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    n = F.col("index.n")
    cuts = (f(F.col("h1") % (n + 1), F.col("h2") % (n + 1)) for f in (F.least, F.greatest))
    first, second = (cut_at(F.col("index"), rank) for rank in cuts)
    split = F.col("form") != "plain"
    rows = rows.select("doc_id", "text", n.alias("n"), form.alias("form"), first.alias("first"), second.alias("second"))
    parts = {"prefix": piece(F.col("text"), F.lit(0), F.col("first")), "middle": piece(F.col("text"), F.col("first"), F.col("second")), "suffix": piece(F.col("text"), F.col("second"))}
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(split, part).alias(name) for name, part in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_first = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_first).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; no part holds a mark, so the marks part it in one way alone."""
    after = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = (F.split(after, f"{mark}|{MIDDLE}", -1) for mark in (SUFFIX, PREFIX))
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Digests of transform(): doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = transform(docs)
    size = {f"{p}_chars": F.char_length(p).cast("long") for p in ("prefix", "middle")}
    return rows.select("doc_id", "n", "form", *(c.alias(name) for name, c in size.items()), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
