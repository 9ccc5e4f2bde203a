"""Running sums and exact quantiles within keys of any size: no key is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.staging import staged


def running_before(rows: DataFrame, keys: list[str], order: list[str], weight: Column, out: str, total: str = "_total") -> DataFrame:
    """rows with the sum of the weights of the rows before each in its key, in the order given (ties in any order), and of
    all rows of its key.

    Rows are dealt in ranges of key and order, so a key with most of the rows spreads over many partitions; sums of each
    key and range (a row for each) give what stands before a range. Null keys are one key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_w", weight).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    tags = {f"_k{i}": c for i, c in enumerate(own)} | {f"_n{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    dealt = dealt.withColumns(tags)
    before = W.partitionBy(*tags).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*tags, "_part").agg(F.sum("_w").alias("_s"))
    sums = sums.select(*tags, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"), F.sum("_s").over(W.partitionBy(*tags)).alias("_all"))
    inside = W.partitionBy(*tags, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(sums, [*tags, "_part"])
    return placed.select(*rows.columns, (F.col("_local") + F.col("_offset")).alias(out), F.col("_all").alias(total))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median: the exact median (mean of the two middle values) of the non-null values of each key.

    Equal values are counted before the shuffle, and only the values on which the middle ranks fall are kept."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    both = running_before(counts, keys, ["_v"], F.col("_c"), "_before", "n")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))
    middle = both.where(holds(low) | holds(high)).groupBy(*keys, "n")
    return middle.agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median"))
