"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked there; the fractional rank (rank + 1/2) / rows of the
source interleaves the sources in proportion, and the order is cut into shards of equal row counts (one apart at most),
so that every shard matches the mixture. Both ranks are distributed: range partitions and their sizes, so a source
spreads over tasks; the number of rows of each source comes by a broadcast as long as sources are few, else by a join.

Null sources are a source of their own, null texts have no bytes, texts may be of any length; repeated rows and ids are
placed one by one, rows alike in source and id in any order. An empty table gives no rows. Columns beside source and
key pass through interleave() under any name, but shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, ranked

SHARDS, SEED, ROW_BYTES = 40, 20250101, 16
#: Sources up to which their row counts are broadcast.
FEW = 100_000


def interleave(rows: DataFrame, source: str = "source", key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    whole = rows.select(F.struct("*").alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"), F.xxhash64(F.lit(seed), key).alias("mix"), F.col(key).alias("key"))
    first = ranked(whole, ["source", "mix", "key"], "pos", "by-source")
    sizes = first.groupBy("source").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    told = sizes.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    share = (F.col("pos") - F.col("first") + 0.5) / F.col("n")
    second = first.join(F.broadcast(sizes) if told["sources"] <= FEW else sizes, "source").select("row", "source", "mix", "key", share.alias("share"))
    out = ranked(second, ["share", "source", "mix", "key"], "pos", "interleaved")
    total = told["rows"]
    shard = F.floor(F.col("pos") * shards / F.lit(max(1, total))).cast("int")
    # the first position of shard k is the least p with floor(p * shards / total) = k
    start = F.ceil(shard.cast("long") * total / F.lit(shards)).cast("long")
    return out.select(*(F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")), shard.alias("shard"), (F.col("pos") - start).alias("slot"))


def layout(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = materialise(docs.select("doc_id", "source", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "rows")
    out = interleave(rows, shards=shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write whole documents into folders shard=0 and so on, in the order of their slots.

    A folder is one file per range of slots, so a shard larger than a task is written by several tasks."""
    placed = interleave(docs, shards=shards, seed=seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
