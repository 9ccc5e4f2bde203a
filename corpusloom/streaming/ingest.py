"""Continuous ingest of texts: copies out, features and gate in, one folder a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import content_hash, core_features
from corpusloom.operators.activity import first_reason, length_gate
from corpusloom.operators.upkeep import ingest_status

STORED = "content_hash string, doc_id long, batch long"


def ingest_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Add a batch's new texts, with features and reason (null: accepted), to the corpus at path.

    The batch's folder is replaced, and a repeated batch ignores what it wrote itself: delivered twice, it changes nothing."""
    spark = batch.sparkSession
    spark.createDataFrame([], STORED).write.mode("append").parquet(f"{path}/keys/batch=-1")
    stored = spark.read.schema(STORED).parquet(f"{path}/keys").where(F.col("batch") != batch_id)
    hashed = batch.withColumn("content_hash", content_hash(F.col("text")))
    fresh = ingest_status(hashed, stored, "content_hash", "doc_id").where("status = 'inserted'").drop("status")
    rows = core_features(fresh).withColumn("reason", first_reason(length_gate(F.col("word_count") / 2.5)))
    drop = [c for c in rows.columns if c.startswith("_")]
    rows.drop(*drop).write.mode("overwrite").parquet(f"{path}/items/batch={batch_id}")
    done = spark.read.parquet(f"{path}/items/batch={batch_id}")
    done.select("content_hash", "doc_id").write.mode("overwrite").parquet(f"{path}/keys/batch={batch_id}")


def ingest(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run ingest_batch on a stream (doc_id, text, ...) until what is there has been read."""
    each = lambda batch, batch_id: ingest_batch(batch, batch_id, path)
    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
