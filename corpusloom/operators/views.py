"""Listings, rosters, progress and the rows behind comparison pages, each for all items at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listing(parts: dict[str, DataFrame], filters: list[Column]) -> DataFrame:
    """Items of several kinds in one list (kind, then the union of columns), under all filters."""
    kinds = [d.withColumn("kind", F.lit(k)) for k, d in parts.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    return rows.where(reduce(lambda a, b: a & b, filters)) if filters else rows


def roster(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with its items in each section, whether each has it, and in how many it is."""
    tagged = [d.select(key, F.lit(s).alias("section")) for s, d in sections.items()]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    out = rows.groupBy(key).agg(*(F.count_if(F.col("section") == s).alias(f"{s}_items") for s in sections))
    flags = [(F.col(f"{s}_items") > 0).cast("int") for s in sections]
    return out.withColumns({f"in_{s}": f for s, f in zip(sections, flags, strict=True)} | {"n_sections": sum(flags[1:], flags[0]).cast("int")})


def progress(items: DataFrame, parts: list[DataFrame], account: str, item: str) -> DataFrame:
    """Items of each account, those that any part analyses, the percentage, and whether all are analysed."""
    done = reduce(lambda a, b: a.union(b), [p.select(item) for p in parts]).distinct().withColumn("_done", F.lit(True))
    rows = items.join(done, item, "left").groupBy(account).agg(F.count("*").alias("items"), F.count("_done").alias("analysed"))
    return rows.withColumns({"percent": 100.0 * F.col("analysed") / F.col("items"), "complete": F.col("analysed") == F.col("items")})


def extremes(prints: DataFrame, profile: str) -> DataFrame:
    """The profile of the largest mean for each attribute (the smaller name at a tie)."""
    best = prints.groupBy("attribute").agg(F.max("mean").alias("mean"))
    return prints.select("attribute", "mean", profile).join(best, ["attribute", "mean"]).groupBy("attribute", "mean").agg(F.min(profile).alias(profile), F.count("*").alias("tied"))


def characteristic(prints: DataFrame, shares: DataFrame, numbers: DataFrame, values: DataFrame, profile: str, item: str, k: int = 2) -> DataFrame:
    """attribute, profile, kind, told, examples: the profile of the largest mean of each number and of the largest share
    of each category with that value (smaller names at a tie), and k of its items: those of the largest numbers, or the
    first that have the value. numbers and values are long rows of profile, item, attribute, value."""
    num = extremes(prints, profile).select("attribute", profile, F.lit("numeric").alias("kind"), F.round("mean", 3).cast("string").alias("told"))
    best = F.min_by(F.struct(profile, "value"), F.struct(-F.col("share"), F.col(profile), F.col("value"))).alias("b")
    cat = shares.groupBy("attribute").agg(best).select("attribute", F.col(f"b.{profile}").alias(profile), F.lit("categorical").alias("kind"), F.col("b.value").alias("told"))
    large = numbers.join(num, ["attribute", profile]).select("attribute", item, (-F.col("value")).alias("by"))
    having = values.join(cat, ["attribute", profile]).where(F.col("value") == F.col("told")).select("attribute", item, F.lit(0.0).alias("by"))
    first = F.row_number().over(W.partitionBy("attribute").orderBy("by", item))
    shown = large.union(having).withColumn("r", first).where(F.col("r") <= k)
    told = shown.groupBy("attribute").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(item).alias("i")))), lambda x: x["i"].cast("string")), ",").alias("examples"))
    return num.union(cat).join(told, "attribute", "left")


def top_values(shares: DataFrame, profile: str, k: int) -> DataFrame:
    """The k most frequent values of each attribute of a profile, by share, then value."""
    place = F.row_number().over(W.partitionBy(profile, "attribute").orderBy(F.col("share").desc(), "value"))
    return shares.withColumn("place", place).where(F.col("place") <= k)


def by_macro(coverage: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Fields, mean percentage, full (99.9 or more) and empty fields of each macro."""
    of = F.create_map(*(F.lit(x) for macro, fields in sections.items() for f in fields for x in (f, macro)))
    rows = coverage.withColumn("macro", of[F.col("attribute")]).where("macro is not null")
    return rows.groupBy("macro").agg(F.count("*").alias("fields"), F.avg("percent").alias("mean_percent"), F.count_if(F.col("percent") >= 99.9).alias("full"), F.count_if(F.col("percent") == 0).alias("empty"))


def stages(first: DataFrame, second: DataFrame, third: DataFrame, key: str, link: str, newest: list[str]) -> DataFrame:
    """Rows of a three-stage production: each key of first with its newest row of second, whether third has that row,
    and the stage reached; rows of second without a first stand by themselves."""
    best = second.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*newest, link)).alias("_b"), F.count("*").alias("n_second")).select(key, "n_second", F.col(f"_b.{link}").alias(link))
    made = third.select(link).distinct().withColumn("_made", F.lit(True))
    rows = first.select(key).withColumn("_first", F.lit(True)).join(best, key, "full").join(made, link, "left")
    stage = F.when(F.col("_made"), "third").when(F.col(link).isNotNull(), "second").otherwise("first")
    return rows.select(key, link, F.coalesce("n_second", F.lit(0)).alias("n_second"), F.coalesce("_first", F.lit(False)).alias("has_first"), stage.alias("stage"))


def deltas(before: DataFrame, after: DataFrame, keys: list[str], targets: DataFrame | None = None) -> DataFrame:
    """Scores after a rewrite beside those before it; delta to one digit, null where there was none before. With targets
    (rows of keys, of any number), is_target tells the profile that a rewrite was made for."""
    pre = before.select(*keys, F.col("score").alias("before"))
    out = after.select(*keys, F.col("score").alias("after")).join(pre, keys, "left").withColumn("delta", F.round(F.col("after") - F.col("before"), 1))
    if targets is None:
        return out
    meant = targets.select(*keys).distinct().withColumn("_meant", F.lit(True))
    return out.join(meant, keys, "left").withColumn("is_target", F.col("_meant").isNotNull()).drop("_meant")
