"""Times along an item: chapter starts, marked transcripts, assembly plans, evenly drawn frames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import half_even

# Words that chapters and cues are not matched by.
STOP = tuple(
    """the and that this with from have which their they what when where were been into about these those there would
could should than them then some more""".split()
)


TIMES = "array<struct<start:double,end:double,method:string,confidence:double>>"
#: Items that a task holds as Python objects at once: a cue takes several hundred bytes then.
ITEMS = 64


def _words(text: str | None, stop: frozenset[str]) -> list[str]:
    return [w for w in re.findall("[a-z']{4,}", (text or "").lower()) if w not in stop]


def _item_times(cues: list, sections: list, duration: float, stop: frozenset[str]) -> list[dict]:
    """Times of one item's chapters; cues are by time."""
    heard = [(c["start"], words) for c in cues if c["start"] is not None and (words := set(_words(c["text"], stop)))]
    length = duration or (max((c["start"] or 0.0 for c in cues), default=-5.0) + 5)
    points = [list(s["points"]) if s["points"] is not None else [] for s in sections]
    weights = [max(1, sum(len(_words(t, stop)) for t in [s["summary"], *p])) for s, p in zip(sections, points, strict=True)]
    out, cursor = [], 0.0
    for i, s in enumerate(sections):
        want = {w for t in [s["title"], s["summary"], *points[i][:2]] for w in _words(t, stop)[:14]}
        fits = [(len(want & words) / min(len(want), 8), -at) for at, words in heard if i and want and at >= cursor + 1]
        fit, at = max(fits, default=(0.0, 0.0))
        found = fit >= 0.5
        place = -at if found else round(length * sum(weights[:i]) / sum(weights), 2)
        behind = bool(i) and place <= cursor
        if behind:
            place = cursor + max(1.0, length / (4 * len(sections)))
        cursor = round(place, 2) if i else 0.0
        matched = found and not behind if i else len(cues) > 0
        sure = (0.0 if behind else round(min(fit, 1.0), 2)) if i else 1.0
        out.append({"start": cursor, "method": "matched" if matched else "allocated", "confidence": sure})
    ends = [t["start"] for t in out[1:]] + [round(length, 2)]
    for here, end in zip(out, ends, strict=False):  # an item without chapters has no time to end
        here["end"] = end
    return out


def chapter_times(items: DataFrame, key: str, stop: tuple[str, ...] = STOP) -> DataFrame:
    """key and times: start, end, method and confidence of each chapter of an item.

    items has duration, cues array<struct<start, text>> by time and sections array<struct<title, summary, points>>. A
    chapter starts at the cue, a second or more after the chapter before, that shares most of its distinctive words (half
    of at most eight at least). Else, and where that would go backwards, it gets a share of the duration by its words.
    Empty or null arrays give no times; a missing duration is that of the last cue and five seconds. Each choice depends
    on the one before, so an item is worked on as a whole, in Arrow batches, without a shuffle; ITEMS of a batch are made
    Python objects at a time, so memory doesn't grow with the batch.
    """
    left_out = frozenset(stop)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = pa.struct([("start", pa.float64()), ("end", pa.float64()), ("method", pa.string()), ("confidence", pa.float64())])
        for batch in batches:
            for at in range(0, batch.num_rows, ITEMS):
                part = batch.slice(at, ITEMS)
                rows = zip(*(part.column(c).to_pylist() for c in ("cues", "sections", "duration")), strict=True)
                times = [_item_times(c or [], s or [], 0.0 if d is None or d != d else d, left_out) for c, s, d in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(times, pa.list_(time))], names=[key, "times"])

    rows = items.select(key, "cues", "sections", F.col("duration").cast("double"))
    kind = items.schema[key].dataType.simpleString()
    return rows.mapInArrow(timed, f"`{key}` {kind}, times {TIMES}")


def marked_transcript(cues: Column, every: int = 40) -> Column:
    """The cues' texts with [MM:SS] before the first and again once so many words stand behind the last mark."""
    texts = F.filter(F.transform(cues, lambda c: F.struct(c["start"].cast("double").alias("start"), F.trim(c["text"]).alias("text"))), lambda c: F.coalesce(c["text"], F.lit("")) != "")
    start = F.struct(F.lit(every).alias("since"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        s = F.floor(c["start"]).cast("long")
        mark = F.concat(F.lit("["), F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("]"))
        due = acc["since"] >= every
        since = F.when(due, 0).otherwise(acc["since"]) + F.size(F.split(c["text"], r"\s+"))
        return F.struct(since.cast("int").alias("since"), F.concat(acc["out"], F.when(due, F.array(mark, c["text"])).otherwise(F.array(c["text"]))).alias("out"))

    return F.aggregate(texts, start, step, lambda acc: F.array_join(acc["out"], " "))


def assembly_plan(beats: DataFrame, item: str, beat: str, least: str, most: str, seconds: str) -> DataFrame:
    """Shots of each beat: max(1, round((least + most) / 2)) of equal length, with start in the item, place and role."""
    n = F.greatest(F.lit(1), F.bround((F.col(least) + F.col(most)) / 2).cast("int"))
    rows = beats.select(item, beat, n.alias("n"), (F.col(seconds) / n).alias("shot_s"), F.col(seconds).alias("_s"))
    before = W.partitionBy(item).orderBy(beat, "_s").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
    rows = rows.select(item, beat, "n", "shot_s", "_from", F.explode(F.sequence(F.lit(1), "n")).alias("shot"))
    role = F.when(F.col("n") == 1, "only").when(F.col("shot") == 1, "first").when(F.col("shot") == F.col("n"), "last").otherwise("middle")
    return rows.select(item, beat, "shot", "shot_s", (F.col("_from") + (F.col("shot") - 1) * F.col("shot_s")).alias("start_s"), role.alias("role"))


def tempo(percent_on_beat: Column, bpm: Column, least: float = 50) -> Column:
    """Seconds of a beat of an account that puts at least so many percent of its cuts on one; null otherwise."""
    return F.when((percent_on_beat >= least) & (bpm > 0), half_even(60.0 / bpm, 4))


def shot_plan(beats: DataFrame, item: str, beat: str) -> DataFrame:
    """A row for each shot of the beats of items, in order: item, beat, shot (from 1 in the item), seconds, subject,
    caption, voiceover, role, previous.

    beats has title, captions, tags and lines (arrays of string), sec_min, sec_max, shot_min, shot_max and beat_sec (null
    without a tempo). A beat has as many shots as the middle of its range, else as it has captions, one at least; its
    middle length is dealt evenly, then snapped to whole beats. Captions are spread over contiguous shots, a tag stands
    on the shot of its number, the lines are spoken under the first shot. previous is the subject of the shot before,
    unless it is the same. (item, beat) is unique."""
    none = F.array().cast("array<string>")
    rows = beats.withColumns({c: F.coalesce(c, none) for c in ("captions", "tags", "lines")})
    lo, smin = F.coalesce("sec_min", F.lit(0.0)), F.coalesce("shot_min", F.lit(0))
    hi, smax = F.coalesce(F.nullif(F.coalesce("sec_max", F.lit(0.0)), F.lit(0.0)), lo), F.coalesce(F.nullif(F.coalesce("shot_max", F.lit(0)), F.lit(0)), smin)
    n = F.when((smin != 0) | (smax != 0), F.rint((smin + smax) / 2)).otherwise(F.greatest(F.size("captions"), F.lit(1)))
    rows = rows.withColumns({"_n": F.greatest(F.lit(1), n.cast("int")), "_len": (lo + hi) / 2})
    even = F.when(F.col("_len") > 0, half_even(F.col("_len") / F.col("_n"), 2))
    snapped = half_even(F.greatest(F.lit(1.0), F.rint(even / F.col("beat_sec"))) * F.col("beat_sec"), 3)
    rows = rows.withColumn("seconds", F.when(F.col("beat_sec").isNotNull() & (even != 0), snapped).otherwise(even))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    at = F.least(F.size("captions") - 1, F.floor(F.col("_i") * F.size("captions") / F.col("_n")).cast("int"))
    subject = F.when(F.size("captions") > 0, F.get("captions", at)).otherwise(F.coalesce("title", F.lit("")))
    spoken = F.when((F.col("_i") == 0) & (F.size("lines") > 0), F.array_join("lines", " "))
    order = W.partitionBy(item).orderBy(beat, "_i")
    rows = rows.select(item, beat, "_i", "seconds", subject.alias("subject"), F.get("tags", F.col("_i")).alias("caption"), spoken.alias("voiceover"))
    rows = rows.withColumns({"shot": F.row_number().over(order), "_total": F.count("*").over(W.partitionBy(item)), "_before": F.lag("subject").over(order)})
    role = F.when(F.col("shot") == 1, "opening").when(F.col("shot") == F.col("_total"), "closing").otherwise("middle")
    return rows.select(item, beat, "shot", "seconds", "subject", "caption", "voiceover", role.alias("role"), F.when(F.col("_before") != F.col("subject"), F.col("_before")).alias("previous"))


def even_frames(frames: DataFrame, item: str, number: str, quota: int, most: int) -> DataFrame:
    """At most quota frames of each item, evenly spread, of the newest items first, most in all (a sampling operator)."""
    here = W.partitionBy(item)
    rows = frames.withColumns({"_i": F.row_number().over(here.orderBy(number)) - 1, "_n": F.count("*").over(here)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / quota))
    drawn = rows.where((F.col("_i") % step == 0) & (F.col("_i") / step < quota)).drop("_i", "_n")
    return drawn.orderBy(F.col(item).desc(), number).limit(most)
