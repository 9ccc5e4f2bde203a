"""Daily spend of an append-only usage feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_spend(events: DataFrame, at: str, site: str, cost: str, cap: float, late: str = "1 hour") -> DataFrame:
    """Calls and cost by day and site, with a flag from the cap on; the same for a batch and for a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    days = rows.groupBy(F.window(at, "1 day").alias("w"), F.col(site).alias("site")).agg(F.count("*").alias("n"), F.sum(cost).alias("spent"))
    return days.select(F.col("w.start").alias("day"), "site", "n", "spent", (F.col("spent") >= cap).alias("over_cap"))
