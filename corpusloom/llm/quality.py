"""Quality rules: plain counts of each text, and a hashed n-gram log-likelihood ratio of a trusted target against the
raw corpus, length-normalised and compared with one threshold for every document. DataFrame functions only.

A null text, or one without words, fails the base rule. Texts may be of any length. Repeated rows are judged alike, and
each counts in the corpus; a text at the threshold stays. Labels of unknown or null ids play no part; with no trusted
document in the corpus all weights are 0. An empty table gives no rows. Extra columns pass through keep() under any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed multinomials; the table of weights has this size at any input size.
BUCKETS = 8192
#: Weights are whole thousandths, so that sums don't depend on the order.
SCALE = 1000
#: Trusted documents for the target multinomial: at most so many, those of smallest hash.
TRUSTED_ROWS = 20_000
#: Nats per n-gram below which a document is rejected.
THRESHOLD = -0.25
#: Added to each count.
PRIOR = 1.0


def bind(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that are found twice or more: windows are sorted by hash, equal neighbours keep
    their places, and each place covers up to the next one or five words."""

    def covered(places: Column) -> Column:
        spans = F.transform(places, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(places, j + 1), x + 5) - x))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def places(rows: Column) -> Column:
        alike = F.filter(rows, lambda r, j: (r["h"] == F.get(rows, j - 1)["h"]) | (r["h"] == F.get(rows, j + 1)["h"]))
        return F.array_sort(F.transform(alike, lambda r: r["i"]))

    def count(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(bind(rows, places), covered)).otherwise(0)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))

    return F.when(F.size(words) > 5, bind(hashes(words), count)).otherwise(0).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words_of(F.col("text"))).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of each word, each pair of words and each word's last three characters."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    one = F.transform(words, lambda w: bucket(w))
    two = F.transform(words, lambda w, i: bucket(w, F.coalesce(F.get(words, i + 1), F.lit(""))))
    tail = F.transform(words, lambda w: bucket(F.lit("~"), F.right(w, F.lit(3))))
    return F.concat(one, two, tail)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of the trusted documents: labelled quality 1, at most `most`, those of smallest hash."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The log-likelihood ratio of each bucket in thousandths. Counts cover every document; only `buckets` rows reach
    the driver. With no trusted documents all weights are 0."""
    mark = F.broadcast(trusted.withColumn("_target", F.lit(1)))
    grams = docs.select("doc_id", words_of(F.col("text")).alias("_words")).join(mark, "doc_id", "left")
    grams = grams.select("_target", F.explode(gram_buckets(F.col("_words"), buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_target").alias("target")).collect()
    raw, target = sum(r.raw for r in rows), sum(r.target for r in rows)
    out = [0] * buckets
    for r in rows if target else []:
        ratio = math.log((r.target + PRIOR) / (target + PRIOR * buckets)) - math.log((r.raw + PRIOR) / (raw + PRIOR * buckets))
        out[r.b] = round(SCALE * ratio)
    return out


def judge(docs: DataFrame, table: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, llr (nats per n-gram) and kept. One pass without a shuffle."""
    weight = F.from_json(F.lit(str(table)), "array<bigint>")
    grams = gram_buckets(F.col("_words"), len(table))
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, b: a + F.get(weight, b))
    out = base_rules(docs).withColumn("llr", F.when(F.col("n_words") > 0, total / (3 * F.col("n_words") * SCALE)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("llr"), F.lit(0.0)) >= threshold)
    return out.withColumn("kept", kept).drop("_words")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table = weights(docs, trusted_ids(labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return judge(docs.select("doc_id", "text"), table).select("doc_id", *names)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns they came with (the operator's own names are not read from them)."""
    table = weights(docs, trusted_ids(labels))
    whole = docs.select(F.struct("*").alias("_row"), "text")
    # unnested, not filtered: a filter would be pushed below the columns it reads and compute them again and again
    return judge(whole, table).select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")
