"""Corpus pipeline: quality rules, toxicity, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; run()
writes each stage as Parquet in the shared folder and reads it again. All stages but the last return the columns of
documents, others that the table has too, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard, packing, quality, toxicity
from corpusloom.llm.common import materialise, read_table, small_batches
from corpusloom.llm.queries import BYTE_FILE, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts and those of under ten words go; one at the threshold
    stays; repeated rows are judged alike and all stay."""
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts score as texts without any feature; one that scores
    one half goes; repeated rows are judged alike."""
    small_batches(spark)
    return toxicity.keep(docs, read_table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id. Rows that share it are one document and
    all stay; texts without words and rows without doc_id are in no group and stay."""
    return jaccard.keep(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of the documents in sequences of 1024 tokens. A null or empty text is a piece with the end
    token alone; long texts are cut, repeated rows are packed one by one."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(BYTE_FILE))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("ngram_jaccard", ngram_jaccard), ("best_fit_packing", best_fit_packing)]

#: SQL can't express the classifiers and the tokenizer; tests/llm holds each stage and run() against versions in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
