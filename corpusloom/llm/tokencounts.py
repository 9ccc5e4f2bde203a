"""Token counts as rollups that deltas maintain.

The state is a log: each commit adds the rows of the documents and tokenizer versions that it touched, and the last one of
a document and version holds. A batch of changes (insert, revise, delete) becomes signed deltas against the state: what
the document counted before is taken off, what it counts now is added. Totals by source, language and version are
additive and change by the sums of deltas alone. So a commit writes what it changes and reads the log's buckets of its
documents. Each batch is one commit, with folders of its own that later ones read, and counts
once its marker stands in the list of commits, which a new driver reads; a batch that was committed before
changes nothing.

Within a batch the last change of a document and version (by seq) holds; of changes with the same seq the largest by
operation, source, language and count. Deletes of unknown documents count as nothing, revisions of them as inserts. Null
sources and languages are values of their own, null texts have no tokens, texts may be of any length; a change without
doc_id is not applied. An empty batch is a commit without changes. Other columns play no part.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, shared_dir

KEYS = ["source", "lang", "version"]
STATE = "doc_id long, version string, seq long, alive boolean, source string, lang string, n_tokens long, bucket int"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
LOG = "seq long, batch string"
#: Buckets of the state's log by document; a commit reads those of its documents alone.
BUCKETS = 64

#: Tokenizer versions: each counts the tokens of a text by a Column.
WHITESPACE = r"[^\x20\x09-\x0D]+"
PIECES = r"[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]"
VERSIONS = {"words-1": WHITESPACE, "pieces-1": PIECES}


def counted(text: Column, version: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


class Rollup:
    """Totals in the shared folder, as a chain of committed batches. One writer at a time; a new object goes on where
    the log of commits ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}"
        # beside the folders that batches name: markers, and the state's log by commit and bucket
        self.log, self.states = f"{self.path}.commits", f"{self.path}.state"
        self.commits = self._logged()
        self.totals = spark.createDataFrame([], TOTALS)
        if self.commits:
            self._open(self.commits[-1])

    def _logged(self) -> list[str]:
        """Names of the committed batches in their order."""
        try:
            return [r.batch for r in self.spark.read.schema(LOG).parquet(self.log).orderBy("seq").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _open(self, batch: str) -> None:
        self.totals = self.spark.read.schema(TOTALS).parquet(f"{self.path}/{batch}/totals")

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """doc_id, version, alive, source, lang, n_tokens as of the last commit, of some buckets or all."""
        rows = self.spark.read.schema(STATE).parquet(self.states) if self.commits else self.spark.createDataFrame([], STATE)
        rows = rows.where(F.col("seq") < len(self.commits))  # what a lost commit left behind has no marker
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))
        last = F.max(F.struct("seq", "alive", "source", "lang", "n_tokens")).alias("s")
        return rows.groupBy("doc_id", "version").agg(last).select("doc_id", "version", "s.alive", "s.source", "s.lang", "s.n_tokens")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (doc_id, source, lang, version, n_tokens, op, seq); False if the batch was committed before."""
        if batch in self.commits:
            return False
        last = changes.where("doc_id is not null").groupBy("doc_id", "version").agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("c"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        last = materialise(last.select("doc_id", "version", "c.op", "c.source", "c.lang", "c.n_tokens", bucket.alias("bucket")), "changes")
        touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # BUCKETS at most
        old = self.state(touched).where("alive").select("doc_id", "version", F.struct("source", "lang", "n_tokens").alias("old"))
        both = last.withColumn("new", F.struct("source", "lang", "n_tokens")).join(old, ["doc_id", "version"], "left")
        both = both.withColumn("now", F.when(F.col("op") != "delete", F.col("new"))).where("now is not null or old is not null")
        kept = F.coalesce("now", "old")
        state = both.select("doc_id", "version", F.col("now").isNotNull().alias("alive"), kept["source"].alias("source"), kept["lang"].alias("lang"), kept["n_tokens"].alias("n_tokens"), "bucket")
        # each task writes one bucket or two, and a bucket is written by as many tasks as there are for it
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        state = state.repartition("bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(slices)))
        state.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.states}/seq={len(self.commits)}")
        signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("v")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("v")))
        delta = both.select("version", F.explode(signed).alias("d")).where("d.v is not null")
        delta = delta.select("d.v.source", "d.v.lang", "version", F.col("d.sign").cast("long").alias("n_docs"), (F.col("d.sign") * F.col("d.v.n_tokens")).alias("n_tokens"))
        totals = self.totals.union(delta).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        totals.write.mode("overwrite").parquet(f"{self.path}/{batch}/totals")
        # both tables are whole: with its marker, one row in a file, the batch counts from here on
        marker = self.spark.range(0, 1, 1, 1).select(F.lit(len(self.commits)).cast("long").alias("seq"), F.lit(batch).alias("batch"))
        marker.write.mode("append").parquet(self.log)
        self.commits.append(batch)
        self._open(batch)
        return True


def changes(docs: DataFrame, versions: list[str], op: str, seq: int) -> DataFrame:
    """One change for each document and version, counted by the version's tokenizer."""
    each = F.array(*(F.struct(F.lit(v).alias("version"), counted(F.col("text"), v).alias("n_tokens")) for v in versions))
    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.explode(each).alias("c"))
    return rows.select("doc_id", "source", "lang", "c.version", "c.n_tokens", F.lit(op).alias("op"), F.lit(seq).alias("seq"))


def history(docs: DataFrame, name: str) -> DataFrame:
    """Totals after a history of all documents: inserted with the words version, revised by the pieces version beside
    it, words taken off documents in German, and the second batch delivered twice."""
    roll = Rollup(docs.sparkSession, name)
    roll.apply("insert", changes(docs, ["words-1"], "insert", 0))
    second = changes(docs, ["pieces-1"], "insert", 1)
    roll.apply("second-version", second)
    roll.apply("second-version", second)
    gone = changes(docs.where("lang = 'de'"), ["words-1"], "delete", 2)
    # a first count that a revision puts right
    wrong = changes(docs.where("lang = 'fr'"), ["words-1"], "revise", 2).withColumn("n_tokens", F.col("n_tokens") + 1)
    roll.apply("corrections", gone.union(wrong))
    roll.apply("right-again", changes(docs.where("lang = 'fr'"), ["words-1"], "revise", 3))
    return roll.totals
