"""Helpers that the training-data operators share: tables in the shared folder, distributed ranks, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts are long, so a batch of the default 10,000 rows could hold gigabytes.
ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where the setting is missing (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked(df: DataFrame, order: list[str], pos: str = "pos", name: str = "ranked") -> DataFrame:
    """Add the 0-based global position of each row in the order of the given columns.

    Range partitions are sorted, each row notes its partition and place there, and the partitions' sizes (one row a
    partition) give the offsets. No key is gathered in one task: equal leading keys spread over partitions by the
    later columns.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the caller's columns stand in one struct, so that no name of theirs meets one of these
    keys = [f"key{i}" for i in range(len(order))]
    rows = df.select(F.struct("*").alias("row"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)))
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("mark"))
    rows = materialise(rows, name).withColumns({"part": F.shiftright("mark", 33), "at": F.col("mark").bitwiseAND((1 << 33) - 1)})
    # one row for each partition of the sort above, so a single window partition is small at any input size
    sizes = rows.groupBy("part").agg((F.max("at") + 1).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.join(F.broadcast(offsets), "part").withColumn("at", F.col("offset") + F.col("at"))
    return placed.select(*(F.col("row")[c].alias(c) for c in df.columns if c != pos), F.col("at").alias(pos))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: (node, component = smallest node reachable), for nodes with a link.

    Alternating large-star and small-star rounds over DataFrames; each round is written to the shared folder. Null ends
    and self-links are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e, "links")
    last = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "links")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(e.select("v", "v").distinct())
