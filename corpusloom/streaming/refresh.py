"""Profiles that follow a stream of items: each batch rebuilds only the accounts that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refresh_batch(batch: DataFrame, batch_id: int, path: str, account: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Add a batch to the items under path and write the profiles of its accounts anew.

    Items stand in a folder a batch, so a batch that comes again replaces its own; profiles are partitioned by account
    and only the partitions of touched accounts are overwritten."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/items/batch={batch_id}")
    touched = batch.select(account).where(F.col(account).isNotNull()).distinct()
    items = spark.read.parquet(f"{path}/items").drop("batch").join(touched, account, "left_semi")
    build(items).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(account).parquet(f"{path}/profiles")


def profiles(spark, path: str) -> DataFrame | None:
    """The profiles as they are now; None before the first batch."""
    try:
        return spark.read.parquet(f"{path}/profiles")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refresh(feed: DataFrame, path: str, checkpoint: str, account: str, build: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Follow a stream of items."""
    return feed.writeStream.foreachBatch(lambda b, i: refresh_batch(b, i, path, account, build)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
