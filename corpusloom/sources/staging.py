"""Tables written once in the shared folder, and a store of runs whose commits can be repeated."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where it names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read from there: lineage is cut, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class RunStore:
    """Append-only runs of library tables. A run is written under its id, table by table, and counts only once its marker,
    written last, is there. Committing an id again does nothing; what a broken commit left behind is written over by the
    next one and never read. One writer a run id.

    Ids are letters, digits, dots, dashes and underscores. Reading an empty store gives None."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def done(self, run: str) -> bool:
        return self._there(f"{self.path}/markers/run_id={run}/_SUCCESS")

    def commit(self, run: str, tables: dict[str, DataFrame]) -> bool:
        """Whether the run was written now; False where it had been before."""
        if not run or run.strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-"):
            raise ValueError(f"not a run id: {run!r}")
        if self.done(run):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/tables/{name}/run_id={run}")
        marker = self.spark.range(1).select(F.array(*map(F.lit, sorted(tables))).alias("tables"), F.current_timestamp().alias("at"))
        marker.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/markers/run_id={run}")
        return True

    def runs(self) -> DataFrame | None:
        """run_id, tables, at of each committed run."""
        folder = f"{self.path}/markers"
        if not self._there(folder):
            return None
        schema = "tables array<string>, at timestamp, run_id string"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder).select("run_id", "tables", "at")

    def read(self, name: str) -> DataFrame | None:
        """Rows of a table of all committed runs, with run_id; runs without a marker are left out."""
        folder, runs = f"{self.path}/tables/{name}", self.runs()
        if runs is None or not self._there(folder):
            return None
        # a run without a marker may have left a broken file, so only the folders of committed runs are opened
        found = [r.run_id for r in runs.where(F.array_contains("tables", name)).select("run_id").collect()]
        if not found:
            return None
        rows = self.spark.read.option("basePath", folder).option("mergeSchema", "true").parquet(*(f"{folder}/run_id={r}" for r in sorted(found)))
        return rows.withColumn("run_id", F.col("run_id").cast("string"))
