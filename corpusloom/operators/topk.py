"""The best rows of one table for each of another by a sum over shared terms, without all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.staging import staged

SLACK = 1e-8  # sums in another order must not lose a tie


def best_matches(asked: DataFrame, known: DataFrame, query: list[str], doc: list[str], term: list[str], k: int = 1, least: float = 0.0, digits: int = 9, last: bool = False, tried: int = 4) -> DataFrame:
    """query, doc, score, place: for each query the k docs of the highest sum of x * y over shared terms, rounded to digits;
    only sums above zero, and from least on. At a tie the smaller doc comes first, the larger with last.

    asked: query, term and x, a row a query and term; known: doc, term and y, likewise; x and y are positive. Rows with a
    null term meet nothing. A query of no shared term has no row, empty tables give none.

    A term adds at most x times its highest y. Docs in which a query's strongest terms are highest are summed first; the k-th
    sum is a floor that the k best reach. The weakest terms that together stay below the floor can't lift a doc over
    it alone, so only docs of the other terms are met, and only those whose bound reaches the floor are summed in full."""
    q = staged(asked.select(*query, *term, F.col("x").cast("double")), "asked_terms")
    d = staged(known.select(*doc, *term, F.col("y").cast("double")), "known_terms")
    tops = d.groupBy(*term).agg(F.max("y").alias("_top"))
    bounds = staged(q.join(tops, term).withColumn("_bound", F.col("x") * F.col("_top")), "term_bounds")
    strongest = bounds.withColumn("_r", F.row_number().over(W.partitionBy(*query).orderBy(F.col("_bound").desc(), *term))).where(F.col("_r") <= tried)
    tie = [F.col(c).desc() if last else F.col(c).asc() for c in doc]
    highest = d.withColumn("_r", F.row_number().over(W.partitionBy(*term).orderBy(F.col("y").desc(), *tie))).where(F.col("_r") <= k + 1)
    first = strongest.select(*query, *term).join(highest.select(*doc, *term), term).select(*query, *doc).distinct()
    sums = first.join(q, query).join(d, [*doc, *term]).groupBy(*query, *doc).agg(F.sum(F.col("x") * F.col("y")).alias("_s"))
    kth = sums.withColumn("_r", F.row_number().over(W.partitionBy(*query).orderBy(F.col("_s").desc()))).where(F.col("_r") == k)
    floors = kth.select(*query, F.greatest(F.col("_s"), F.lit(float(least))).alias("_floor"))
    # terms from the weakest on: those whose bounds add up to less than the floor only add to docs met otherwise
    rising = W.partitionBy(*query).orderBy("_bound", *term)
    ruled = bounds.join(floors, query, "left").withColumn("_floor", F.coalesce("_floor", F.lit(float(least))) - SLACK)
    ruled = ruled.withColumn("_weak", F.sum("_bound").over(rising.rowsBetween(W.unboundedPreceding, 0)) < F.col("_floor"))
    rest = F.sum(F.when(F.col("_weak"), F.col("_bound")).otherwise(0.0)).over(W.partitionBy(*query))
    ruled = staged(ruled.withColumn("_rest", rest).select(*query, *term, "x", "_weak", "_rest", "_floor"), "ruled_terms")
    met = ruled.where("not _weak").join(d, term).groupBy(*query, *doc, "_rest", "_floor").agg(F.sum(F.col("x") * F.col("y")).alias("_part"))
    met = staged(met.where(F.col("_part") + F.col("_rest") >= F.col("_floor")).select(*query, *doc, "_part"), "met_docs")
    added = met.select(*query, *doc).join(ruled.where("_weak").select(*query, *term, "x"), query).join(d, [*doc, *term])
    added = added.groupBy(*query, *doc).agg(F.sum(F.col("x") * F.col("y")).alias("_more"))
    score = F.round(F.col("_part") + F.coalesce("_more", F.lit(0.0)), digits)
    scored = met.join(added, [*query, *doc], "left").select(*query, *doc, score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= least))
    place = F.row_number().over(W.partitionBy(*query).orderBy(F.col("score").desc(), *tie))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def unit_words(words: DataFrame, key: str, out: str) -> DataFrame:
    """key, word, out: each word's count over the length of the key's vector of counts; words holds a row an occurrence."""
    counts = words.groupBy(key, "word").agg(F.count("*").alias("_n"))
    lengths = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_length"))
    return counts.join(lengths, key).select(key, "word", (F.col("_n") / F.col("_length")).alias(out))


def best_cosines(a: DataFrame, b: DataFrame, key_a: str, key_b: str, k: int = 1) -> DataFrame:
    """key_a, key_b, cosine, place: the k keys of b whose word counts are likest to a key of a (the smaller key at a tie);
    a and b hold a row a word occurrence. Keys that share no word have no row."""
    best = best_matches(unit_words(a, key_a, "x"), unit_words(b, key_b, "y"), [key_a], [key_b], ["word"], k)
    return best.withColumnRenamed("score", "cosine")


def best_overlaps(candidates: DataFrame, accounts: DataFrame, key_a: str, key_b: str, k: int = 3) -> DataFrame:
    """key_a, key_b, shared, overlap, place: the k accounts whose vocabulary holds most of a candidate's distinct words (the
    smaller key at a tie); a row a word occurrence on either side."""
    x, y = (rows.distinct().withColumn(c, F.lit(1.0)) for rows, c in ((candidates, "x"), (accounts, "y")))
    sizes = x.groupBy(key_a).agg(F.count("*").alias("_n"))
    best = best_matches(x, y, [key_a], [key_b], ["word"], k, digits=0).join(sizes, key_a)
    return best.select(key_a, key_b, F.col("score").cast("long").alias("shared"), (F.col("score") / F.col("_n")).alias("overlap"), "place")
