"""Streams with keyed state: texts taken in once, and profiles that follow inserts, edits, moves and removals.

State is kept by key in the state store under the query's checkpoint, so a batch touches the keys it brings and no table
of all keys or items is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import content_hash, core_features
from corpusloom.operators.activity import first_reason, length_gate

#: Buckets of accounts that value counts stand in; a batch reads and writes those of its accounts.
BUCKETS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(spark: SparkSession) -> None:
    """State on the executors' disks instead of their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def first_of_text(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The smallest doc_id of a content hash in the first batch that brings it; nothing for a hash that is known."""
    if state.exists:
        return
    best = None
    for frame in frames:
        row = frame.nsmallest(1, "doc_id")
        best = row if best is None or int(row["doc_id"].iloc[0]) < int(best["doc_id"].iloc[0]) else best
    if best is not None:
        state.update((int(best["doc_id"].iloc[0]),))
        yield best[["doc_id", "text", "content_hash"]]


def ingest_once(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add new texts of a feed (doc_id, text) to the corpus at path, with features and reason (null: accepted).

    A text counts by its content hash. Copies in one batch leave the row of the smallest doc_id; later ones, files
    delivered twice and files out of order change nothing. Rows without doc_id are left out; null and empty texts are one
    text. The sink commits a batch as a whole, so a batch that is repeated after a failure is not added twice."""
    keyed(feed.sparkSession)
    rows = feed.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), content_hash(F.col("text")).alias("content_hash"))
    fresh = rows.groupBy("content_hash").applyInPandasWithState(first_of_text, "doc_id long, text string, content_hash string", "doc_id long", "append", GroupStateTimeout.NoTimeout)
    done = core_features(fresh).withColumn("reason", first_reason(length_gate(F.col("word_count") / 2.5)))
    done = done.drop(*(c for c in done.columns if c.startswith("_")))
    return done.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed_changes(feed: DataFrame, item: str, account: str, attributes: list[str]) -> DataFrame:
    """account, attribute, value, sign: what an item's newest row takes from its old account and gives to its new one.

    feed: item, seq (the order of an item's rows), account, removed and the attributes. Of an item's rows in a batch the
    one of the largest seq counts; rows that come after a newer one change nothing. Null values, null accounts and removed
    items give nothing; rows without item or seq are left out."""

    def change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        new = None
        for frame in frames:
            row = frame.loc[frame["seq"].idxmax()]
            new = row if new is None or row["seq"] > new["seq"] else new
        if new is None or (old is not None and int(new["seq"]) <= old[0]):
            return
        there = not pd.isna(new["account"]) and not bool(new["removed"])
        values = [None if pd.isna(new[a]) else float(new[a]) for a in attributes]
        state.update((int(new["seq"]), new["account"] if there else None, values))
        out = []
        if old is not None and old[1] is not None:
            out += [(old[1], a, v, -1) for a, v in zip(attributes, old[2], strict=True) if v is not None]
        if there:
            out += [(new["account"], a, v, 1) for a, v in zip(attributes, values, strict=True) if v is not None]
        if out:
            yield pd.DataFrame(out, columns=["account", "attribute", "value", "sign"])

    keyed(feed.sparkSession)
    rows = feed.where(F.col(item).isNotNull() & F.col("seq").isNotNull())
    rows = rows.select(F.col(item).alias("item"), F.col("seq").cast("long"), F.col(account).cast("string").alias("account"), F.coalesce("removed", F.lit(False)).alias("removed"), *(F.col(a).cast("double").alias(a) for a in attributes))
    return rows.groupBy("item").applyInPandasWithState(change, "account string, attribute string, value double, sign int", "seq long, account string, values array<double>", "append", GroupStateTimeout.NoTimeout)


COUNTS = "account string, attribute string, value double, n long"


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest finished batch of each bucket, of those before a batch (a row a bucket that a batch touched)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    log = spark.read.schema("bucket int, batch long").option("basePath", f"{path}/log").parquet(f"{path}/log")
    log = log if before is None else log.where(F.col("batch") < before)
    return {r.bucket: r.batch for r in log.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _counts(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    folders = [f"{path}/counts/batch={batch}/bucket={bucket}" for bucket, batch in sorted(versions.items())]
    return spark.read.schema(COUNTS).parquet(*folders) if folders else spark.createDataFrame([], COUNTS)


def merge_counts(changes: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> None:
    """Add a batch's signed changes to the value counts at path. Only the buckets of its accounts are read and written, as
    the batch's own version, which counts once the log names it; a batch that comes again writes its version anew, from
    the versions before it."""
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64("account"), F.lit(buckets)).cast("int")
    changes.groupBy("account", "attribute", "value").agg(F.sum("sign").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
    made = spark.read.schema(COUNTS).parquet(f"{path}/changes/batch={batch_id}")
    touched = [r.bucket for r in made.select(bucket.alias("bucket")).distinct().collect()]  # at most so many as buckets
    if not touched:
        return
    versions = {b: v for b, v in _versions(spark, path, batch_id).items() if b in set(touched)}
    rows = _counts(spark, path, versions).union(made).groupBy("account", "attribute", "value").agg(F.sum("n").alias("n"))
    # a row of zero for each touched bucket, so that a bucket that has lost its last account has a folder too
    none = spark.createDataFrame([(b,) for b in touched], "bucket int").selectExpr("cast(null as string) account", "cast(null as string) attribute", "cast(null as double) value", "0L n", "bucket")
    out = rows.where("n > 0").withColumn("bucket", bucket).unionByName(none)
    out.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts/batch={batch_id}")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")


def follow(feed: DataFrame, path: str, checkpoint: str, item: str, account: str, attributes: list[str]) -> StreamingQuery:
    """Keep the value counts at path in step with a feed of items until what is there has been read."""
    changes = signed_changes(feed, item, account, attributes)
    return changes.writeStream.foreachBatch(lambda b, i: merge_counts(b, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """account, attribute, n, mean, std, low, high, median from the value counts as they are now."""
    rows = _counts(spark, path, _versions(spark, path)).where("n > 0")
    of = W.partitionBy("account", "attribute")
    total = F.sum("n").over(of)
    rows = rows.withColumn("mean", F.sum(F.col("value") * F.col("n")).over(of) / total)
    return rows.groupBy("account", "attribute").agg(
        F.sum("n").alias("n"),
        F.first("mean").alias("mean"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)) / F.sum("n")).alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.percentile("value", 0.5, F.col("n")).alias("median"),
    )
