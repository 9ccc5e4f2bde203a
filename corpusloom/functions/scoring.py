"""Score formulas as Column expressions on joined rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_subscore(value: Column, low: Column, high: Column, middle: Column) -> Column:
    """0 to 100 by where a value lies to a profile's range; null where either is missing.

    Inside the range 60 at least; outside it falls with the overshoot; a profile of one value decays around it."""
    span, off = high - low, F.abs(value - middle)
    alone = F.greatest(F.lit(0.0), 100 - 40 * off / F.greatest(0.15 * F.abs(middle), F.lit(0.5)))
    inside = F.greatest(F.lit(60.0), 100 - 40 * off / (span / 2))
    over = F.when(value < low, low - value).otherwise(value - high)
    outside = F.greatest(F.lit(0.0), 60 - 40 * over / span)
    known = value.isNotNull() & middle.isNotNull()
    return F.when(known, F.when(span <= 1e-9, alone).when((value >= low) & (value <= high), inside).otherwise(outside))


def categorical_subscore(share: Column, recorded: Column) -> Column:
    """20 + 0.8 of the share in percent; 20 for a value never seen; null where the attribute was never recorded."""
    return F.when(recorded, 20 + 0.8 * F.coalesce(share, F.lit(0.0)))


def intrinsic(f: dict[str, Column]) -> tuple[Column, Column]:
    """The total of eight rules (0 to 100) and array<struct<rule, passed, points>>."""
    rules = [
        ("length", f["word_count"].between(150, 350), 15),
        ("readability", f["readability_score"].between(6, 11), 15),
        ("direct_address", f["you_freq_per_100w"] >= 1.5, 15),
        ("question", f["question_count"] >= 1, 10),
        ("jargon", f["jargon_density"] <= 0.03, 15),
        ("quote", f["quote_count"] >= 1, 10),
        ("beats", f["beat_count"] >= 3, 10),
        ("closing_question", f["ends_on_question"] == 1, 10),
    ]
    each = [F.struct(F.lit(n).alias("rule"), p.alias("passed"), F.when(p, w).otherwise(0).alias("points")) for n, p, w in rules]
    return sum((F.when(p, w).otherwise(0) for _, p, w in rules), F.lit(0)) * 100.0 / sum(w for *_, w in rules), F.array(*each)
