"""Subtitle folders followed by a stream: texts and durations of new files, kept so that a batch may come twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.titles import cue_seconds
from corpusloom.sources import readers

KEPT = "path string, folder string, shortcode string, modified timestamp, text string, last_cue string, status string, batch long"


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str, files: int = 10_000) -> StreamingQuery:
    """Write the subtitle files under folder that aren't in store yet, a folder a batch of so many files at most, until
    what is there has been read. What was read is known by the checkpoint; a batch that comes again replaces itself."""
    rows = readers.subtitles(spark, folder, files)
    each = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, store: str) -> DataFrame:
    """Rows of all files that were followed."""
    return spark.read.schema(KEPT).parquet(store)


def durations(rows: DataFrame) -> DataFrame:
    """shortcode, duration_sec: the latest end of a cue in the files of a code (languages and folders are several files); codes
    of no cue and files without a code have no row."""
    ends = rows.where("shortcode is not null").select("shortcode", cue_seconds(F.col("last_cue")).alias("_end")).where("_end is not null")
    return ends.groupBy("shortcode").agg(F.round(F.max("_end"), 2).alias("duration_sec"))
