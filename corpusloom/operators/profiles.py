"""Profiles: fingerprints of accounts, blends, comparisons, drift, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from corpusloom.functions.scoring import numeric_subscore
from corpusloom.functions.text import half_even
from corpusloom.operators import ranking
from corpusloom.sources.staging import staged


def dedup(items: DataFrame, owner: str, key: str, item: str) -> DataFrame:
    """The smallest item of each owner and content key; items without a key never collapse."""
    shown = F.coalesce(F.col(key), F.concat(F.lit("v"), F.col(item).cast("string")))
    keep = items.groupBy(owner, shown.alias("_k")).agg(F.min(item).alias(item)).select(item)
    return items.join(keep, item, "left_semi")


def long_numeric(items: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """keys, attribute, value; nulls are left out."""
    rows = items.select(*keys, *(F.col(a).cast("double").alias(a) for a in attributes))
    return rows.unpivot(keys, attributes, "attribute", "value").where("value is not null")


def long_categorical(items: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    rows = items.select(*keys, *(F.col(a).cast("string").alias(a) for a in attributes))
    return rows.unpivot(keys, attributes, "attribute", "value").where("value is not null")


def numeric_fingerprint(rows: DataFrame, profile: str, values: bool = False) -> DataFrame:
    """Statistics of each profile and attribute. values adds the sorted values (as long as the profile has items)."""
    more = [F.sort_array(F.collect_list("value")).alias("values")] if values else []
    return rows.groupBy(profile, "attribute").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.percentile("value", 0.5).alias("median"),
        *more,
    )


def hot_fingerprint(rows: DataFrame, profile: str) -> DataFrame:
    """numeric_fingerprint() for profiles that may hold most of all items: the medians come from ranges of ranked values,
    so no task holds the distinct values of a profile, and all other statistics are partial sums.

    rows are written once, as the medians need them a second time. A null profile is one profile, nulls and values that
    are no number (NaN) are left out; equal values share a rank, so repeats change nothing."""
    kept = staged(rows.where(F.col("value").isNotNull() & ~F.isnan("value")), "values")
    told = kept.groupBy(profile, "attribute").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    middle = ranking.medians(kept, [profile, "attribute"], "value").select(F.col(profile).alias("_p"), F.col("attribute").alias("_a"), "median")
    return told.join(middle, F.col(profile).eqNullSafe(F.col("_p")) & F.col("attribute").eqNullSafe(F.col("_a"))).drop("_p", "_a")


def categorical_fingerprint(rows: DataFrame, profile: str) -> DataFrame:
    """Share in percent of each value among the non-null ones, to one digit: scores, overlaps and drift read it so."""
    counts = rows.groupBy(profile, "attribute", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", half_even(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(profile, "attribute")), 1))


def blend(prints: DataFrame, weights: DataFrame, profile: str, hybrid: str) -> DataFrame:
    """Fingerprints of hybrids: weighted means over the sources that have the attribute, to three digits; values, where
    the fingerprints have them, are pooled in order."""
    rows = prints.join(weights, profile)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("weight")) / F.sum("weight"), 3).alias(c)
    pooled = [F.sort_array(F.flatten(F.collect_list("values"))).alias("values")] if "values" in prints.columns else []
    return rows.groupBy(hybrid, "attribute").agg(*(mean(c) for c in ("mean", "std", "low", "high", "median")), F.count("*").alias("sources"), *pooled)


def score(items: DataFrame, prints: DataFrame, item: str, profile: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean subscore (0 without any; weight 1 where none is given) of each item and profile, with the number of
    attributes that counted. Items and profiles meet as one row each, in blocks, not attribute by attribute."""
    from corpusloom.operators.scoring import pairs_in_blocks

    left = items.groupBy(item).agg(F.collect_list(F.struct("attribute", "value")).alias("_values"))
    right = prints.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("attribute", F.struct("low", "high", "median").alias("r")))).alias("_ranges"))
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None

    def sub(v: Column) -> Column:
        r = F.try_element_at("_ranges", v["attribute"])
        w = F.lit(1.0) if table is None else F.coalesce(F.try_element_at(table, v["attribute"]), F.lit(1.0))
        return F.struct(F.round(numeric_subscore(v["value"], r["low"], r["high"], r["median"]), 1).alias("s"), w.alias("w"))

    pairs = pairs_in_blocks(left, right, item, profile).withColumn("_subs", F.filter(F.transform("_values", sub), lambda x: x["s"].isNotNull()))
    total = lambda f: F.aggregate("_subs", F.lit(0.0), lambda a, x: a + f(x))
    weight = total(lambda x: x["w"])
    mean = F.when(weight > 0, total(lambda x: x["s"] * x["w"]) / weight).otherwise(0.0)
    return pairs.select(item, profile, mean.alias("score"), F.size("_subs").cast("long").alias("n_attributes"))


def rank(scores: DataFrame, item: str, profile: str) -> DataFrame:
    """Place of each profile for an item: best score first, then the profile's order."""
    return scores.withColumn("place", F.row_number().over(W.partitionBy(item).orderBy(F.col("score").desc_nulls_last(), profile)))


def similarity(prints: DataFrame, profile: str) -> DataFrame:
    """Mean likeness of every two profiles over the numeric attributes that both have; pairs without any are left out."""
    from corpusloom.operators.scoring import pairs_in_blocks

    one = prints.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "mean"))).alias("m"))
    pairs = pairs_in_blocks(one.select(F.col(profile).alias("a"), F.col("m").alias("x")), one.select(F.col(profile).alias("b"), F.col("m").alias("y")), "a", "b").where("a < b")

    def like(k: Column) -> Column:
        x, y = F.element_at("x", k), F.element_at("y", k)
        return 1 - F.least(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-6)), F.lit(1.0))

    both = pairs.withColumn("_likes", F.transform(F.array_intersect(F.map_keys("x"), F.map_keys("y")), like)).where(F.size("_likes") > 0)
    return both.select("a", "b", (F.aggregate("_likes", F.lit(0.0), lambda s, v: s + v) / F.size("_likes")).alias("similarity"), F.size("_likes").cast("long").alias("n_attributes"))


def similarity_rows(prints: DataFrame, shares: DataFrame, profile: str) -> DataFrame:
    """a, b, attribute, kind, percent: likeness of every two profiles in each attribute that both have.

    Numbers by their relative difference, categories by the overlap of their shares; to one digit. The profiles are
    paired in blocks, one row a profile, and their attributes compared within the pair."""
    from corpusloom.operators.scoring import pairs_in_blocks

    num = prints.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "mean"))).alias("num"))
    each = shares.groupBy(profile, "attribute").agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("m"))
    cat = each.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "m"))).alias("cat"))
    one = num.join(cat, profile, "full")
    left = one.select(F.col(profile).alias("a"), F.col("num").alias("na"), F.col("cat").alias("ca"))
    right = one.select(F.col(profile).alias("b"), F.col("num").alias("nb"), F.col("cat").alias("cb"))
    pairs = pairs_in_blocks(left, right, "a", "b").where("a < b")
    both = lambda x, y: F.coalesce(F.array_intersect(F.map_keys(x), F.map_keys(y)), F.array().cast("array<string>"))

    def number(k: Column) -> Column:
        x, y = F.element_at("na", k), F.element_at("nb", k)
        off = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-6))
        return F.struct(k.alias("attribute"), F.lit("numeric").alias("kind"), F.round(100 * (1 - F.least(off, F.lit(1.0))), 1).alias("percent"))

    def category(k: Column) -> Column:
        x, y = F.element_at("ca", k), F.element_at("cb", k)
        shared = F.aggregate(F.map_entries(x), F.lit(0.0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at(y, e["key"]), F.lit(0.0))))
        return F.struct(k.alias("attribute"), F.lit("categorical").alias("kind"), F.round(shared, 1).alias("percent"))

    return pairs.select("a", "b", F.inline(F.concat(F.transform(both("na", "nb"), number), F.transform(both("ca", "cb"), category))))


def overall_similarity(rows: DataFrame) -> DataFrame:
    """a, b, percent: the mean over the attributes of similarity_rows(), and their number."""
    return rows.groupBy("a", "b").agg(F.round(F.avg("percent"), 1).alias("percent"), F.count("*").alias("n_attributes"))


def profile_rows(items: DataFrame, profile: str, least: int, media: str, title: str) -> DataFrame:
    """profile, n, status (confirmed from least items on), media (the most frequent, the smaller at a tie), overview
    (distinct titles in order) of the analysed items."""
    kinds = items.where(F.col(media).isNotNull()).groupBy(profile, media).agg(F.count("*").alias("_k"))
    main = kinds.groupBy(profile).agg(F.min_by(media, F.struct(-F.col("_k"), F.col(media))).alias(media))
    rows = items.groupBy(profile).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(title)), "; ").alias("overview"))
    return rows.join(main, profile, "left").withColumn("status", F.when(F.col("n") >= least, "confirmed").otherwise("draft"))


def hybrid_shares(shares: DataFrame, weights: DataFrame, profile: str, hybrid: str) -> DataFrame:
    """Shares of hybrids: weighted sums over the weight of the sources that have the attribute, to three digits."""
    rows = shares.join(weights, profile)
    total = rows.select(hybrid, "attribute", profile, "weight").distinct().groupBy(hybrid, "attribute").agg(F.sum("weight").alias("_w"))
    sums = rows.groupBy(hybrid, "attribute", "value").agg(F.sum(F.col("share") * F.col("weight")).alias("_s"))
    return sums.join(total, [hybrid, "attribute"]).select(hybrid, "attribute", "value", F.round(F.col("_s") / F.col("_w"), 3).alias("share"))


def boolean_fingerprint(rows: DataFrame, profile: str) -> DataFrame:
    """Numeric fingerprint of yes/no attributes: the mean is the share of yes; empty strings are no answer."""
    yes = F.when(F.lower("value").isin("1", "true", "yes"), 1.0).when(F.lower("value").isin("0", "false", "no"), 0.0)
    return numeric_fingerprint(rows.withColumn("value", yes).where("value is not null"), profile)


def drift(now: DataFrame, then: DataFrame, profile: str) -> DataFrame:
    """Change of each attribute's mean since a snapshot, to three digits, and that in percent, to one."""
    old = then.select(profile, "attribute", F.col("mean").alias("before"))
    rows = old.join(now.select(profile, "attribute", F.col("mean").alias("after")), [profile, "attribute"])
    rows = rows.where("before is not null and after is not null").withColumn("delta", half_even(F.col("after") - F.col("before"), 3))
    return rows.select(profile, "attribute", "before", "after", "delta", F.when(F.col("before") != 0, half_even(100 * F.col("delta") / F.abs("before"), 1)).alias("percent"))


def category_drift(now: DataFrame, then: DataFrame, profile: str) -> DataFrame:
    """Total variation distance of the shares of each attribute, in percent points."""
    key = [profile, "attribute", "value"]
    both = now.select(*key, F.col("share").alias("x")).join(then.select(*key, F.col("share").alias("y")), key, "full")
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.groupBy(profile, "attribute").agg((F.sum(gap) / 2).alias("distance"))


def coverage(items: DataFrame, attributes: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """attribute, kind, filled rows, share in percent, n_values, and by kind: least, largest and mean value of numbers,
    yes and no of flags (boolean columns, and those named that hold 0 and 1). In one pass; text is never read as a number."""
    kinds = {}
    for a in attributes:
        kind = items.schema[a].dataType
        kinds[a] = "flag" if a in flags or isinstance(kind, BooleanType) else "number" if isinstance(kind, NumericType) else "text"
    none = F.lit(None).cast("double")
    number = lambda a: F.col(a).cast("double") if kinds[a] != "text" else none
    each = [F.struct(F.lit(a).alias("attribute"), F.lit(k).alias("kind"), F.col(a).cast("string").alias("value"), number(a).alias("n")) for a, k in kinds.items()]
    rows = items.select(F.inline(F.array(*each)))
    of_numbers = lambda f, name: f(F.when(F.col("kind") == "number", F.col("n"))).alias(name)
    flag = lambda yes, name: F.when(F.first("kind") == "flag", F.count_if((F.col("n") != 0) == F.lit(yes))).alias(name)
    return rows.groupBy("attribute").agg(
        F.first("kind").alias("kind"),
        F.count("value").alias("filled"),
        (100.0 * F.count("value") / F.count("*")).alias("percent"),
        of_numbers(F.min, "low"),
        of_numbers(F.max, "high"),
        of_numbers(F.avg, "mean"),
        F.count_distinct("value").alias("n_values"),
        flag(True, "n_true"),
        flag(False, "n_false"),
    )