"""Complete scores of items against profiles: numeric and categorical attributes in one weighted mean, members of an
account's corpus, profiles of other media, breakdowns by macro."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.scoring import categorical_subscore, numeric_subscore
from corpusloom.functions.text import half_even

#: Blocks that profiles are dealt in.
BLOCKS = 1
#: Tasks of a pairing to each of the shuffle's: salts fall on tasks unevenly, more of them even that out.
DEALT = 4


def pairs_in_blocks(items: DataFrame, profiles: DataFrame, item: str, profile: str, blocks: int = BLOCKS) -> DataFrame:
    """Every item with every profile, in blocks of profiles dealt over DEALT times as many tasks as the shuffle has.

    Profiles are one row each; items are dealt by a salt, so that no task holds all items of a block. An item is copied
    to each block, a profile to each salt: more blocks are for profiles that outgrow a task. Nothing is counted, so no
    job runs before the caller's own. The number of tasks is named, as items are few bytes for the work that their pairs
    make: by their size alone, Spark would put them into one or two tasks."""
    parts = DEALT * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, parts // blocks)
    at = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.withColumn("_salt", at(item, salts)).withColumn("_block", every(blocks))
    right = profiles.withColumn("_block", at(profile, blocks)).withColumn("_salt", every(salts))
    return left.repartition(parts, "_block", "_salt").join(right, ["_block", "_salt"]).drop("_block", "_salt")


def item_maps(numeric: DataFrame, categorical: DataFrame, item: str) -> DataFrame:
    """item, numbers (attribute to value), values (attribute to category): one row an item, from long rows."""
    num = numeric.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("numbers"))
    cat = categorical.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("values"))
    return num.join(cat, item, "full")


def profile_maps(prints: DataFrame, shares: DataFrame, profile: str) -> DataFrame:
    """profile, ranges (attribute to low, high, median), shares (attribute to value to percent): one row a profile."""
    num = prints.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("attribute", F.struct("low", "high", "median").alias("r")))).alias("ranges"))
    each = shares.groupBy(profile, "attribute").agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("m"))
    cat = each.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "m"))).alias("shares"))
    return num.join(cat, profile, "full")


def comparable(profiles: DataFrame, excluded_media: tuple[str, ...] = ("ProductionSpec",), media: str = "media", status: str = "status") -> DataFrame:
    """Profiles that items are scored against: no excluded medium; confirmed ones, or all where none is confirmed."""
    rows = profiles.where(F.col(media).isNull() | ~F.col(media).isin(*excluded_media))
    some = rows.agg(F.coalesce(F.bool_or(F.col(status) == "confirmed"), F.lit(False)).alias("_some"))
    return rows.join(F.broadcast(some), F.lit(True)).where(~F.col("_some") | (F.col(status) == "confirmed")).drop("_some")  # one row


def subscores(shared: list[str] | None = None, shares_only: Column | None = None) -> Column:
    """array<struct<attribute, subscore>> of a paired row; with shares_only true, of the shared attributes alone."""
    inside = (lambda k: F.lit(True)) if shared is None else (lambda k: ~shares_only | k.isin(*shared))

    def pick(name: str, kind: str) -> Column:
        entries = F.coalesce(F.map_entries(name), F.array().cast(f"array<struct<key:string,value:{kind}>>"))
        return F.filter(entries, lambda e: inside(e["key"]))

    def met(entries: Column, told: str) -> Column:
        # looked up once an entry: an expression would be evaluated wherever the formula names it
        return F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.try_element_at(told, e["key"]).alias("r")))

    def of_number(e: Column) -> Column:
        r = e["r"]
        return F.struct(e["k"].alias("attribute"), F.round(numeric_subscore(e["v"], r["low"], r["high"], r["median"]), 1).alias("subscore"))

    def of_value(e: Column) -> Column:
        return F.struct(e["k"].alias("attribute"), F.round(categorical_subscore(F.try_element_at(e["r"], e["v"]), e["r"].isNotNull()), 1).alias("subscore"))

    both = F.concat(F.transform(met(pick("numbers", "double"), "ranges"), of_number), F.transform(met(pick("values", "string"), "shares"), of_value))
    return F.filter(both, lambda s: s["subscore"].isNotNull())


def weighted_mean(scored: Column, weights: dict[str, float] | Column | None = None) -> Column:
    """Mean of the subscores by weight (1 where none is given), to one digit; null without any. weights may be a map column."""
    table = weights
    if not isinstance(weights, Column):
        table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None
    weight = (lambda s: F.lit(1.0)) if table is None else (lambda s: F.coalesce(F.try_element_at(table, s["attribute"]), F.lit(1.0)))
    total = lambda f: F.aggregate(scored, F.lit(0.0), lambda a, s: a + f(s))
    return F.when(total(weight) > 0, F.round(F.round(total(lambda s: s["subscore"] * weight(s)) / total(weight), 6), 1))


def edited_weights(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """attribute, weight, kind of the weights table after edits (attribute, weight as text or number; the last edit, by
    edit_id, holds). An edit that is no finite number of 0 or more, or names an attribute that isn't stored, changes
    nothing; a null one sets the default of 1."""
    number = F.col("weight").try_cast("double")
    valid = F.col("weight").isNull() | ((number >= 0) & (number < float("inf")))
    last = edits.where(valid).groupBy("attribute").agg(F.max_by(F.struct(F.coalesce(number, F.lit(1.0)).alias("w")), "edit_id").alias("_e"))
    return stored.join(last, "attribute", "left").select("attribute", F.coalesce(F.col("_e.w"), F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), "kind")


def weight_row(weights: DataFrame) -> DataFrame:
    """One row with the weights table as a map: it has a row for each attribute that is scored, whatever the data's size."""
    pairs = F.collect_list(F.struct("attribute", F.col("weight").cast("double").alias("weight")))
    return weights.where("attribute is not null and weight is not null").dropDuplicates(["attribute"]).agg(F.map_from_entries(pairs).alias("_weights"))


def complete_scores(items: DataFrame, profiles: DataFrame, item: str, profile: str, weights: dict[str, float] | DataFrame | None = None, shared: list[str] | None = None, book: str = "Book") -> DataFrame:
    """item, profile, score, n_attributes, breakdown for every pair of item_maps() and profile_maps() rows.

    Profiles whose media is that of books are scored on the shared attributes alone and get no score without any; others
    get 0 without any. weights may be the weights table (attribute, weight): attributes without a row weigh 1."""
    rows = pairs_in_blocks(items, profiles, item, profile)
    if isinstance(weights, DataFrame):
        rows = rows.join(F.broadcast(weight_row(weights)), F.lit(True))  # one row
        weights = F.col("_weights")
    is_book = F.coalesce(F.col("media") == book, F.lit(False))
    rows = rows.withColumn("_subs", subscores(shared, is_book))
    score = weighted_mean(F.col("_subs"), weights)
    return rows.select(item, profile, F.when(is_book, score).otherwise(F.coalesce(score, F.lit(0.0))).alias("score"), F.size("_subs").cast("long").alias("n_attributes"), F.map_from_entries("_subs").alias("breakdown"))


def with_members(scores: DataFrame, members: DataFrame, item: str, profile: str) -> DataFrame:
    """Scores, replaced where members (item, profile, match, similarity) names the item: 100 for exact copies, 85 and 15
    times the similarity for near ones; members have no breakdown."""
    rows = scores.join(members, [item, profile], "left")
    told = F.when(F.col("match") == "exact", 100.0).when(F.col("match").isNotNull(), F.round(85 + 15 * F.col("similarity"), 1)).otherwise(F.col("score"))
    return rows.withColumn("score", told).withColumn("breakdown", F.when(F.col("match").isNull(), F.col("breakdown")))


def rated(scores: DataFrame, members: DataFrame, item: str, profile: str) -> DataFrame:
    """A rating run's rows: scores with members in place of estimates, ranked (null scores last, ties in profile order),
    with is_member and what matched. One row an item and profile."""
    rows = with_members(scores, members, item, profile).withColumn("is_member", F.col("match").isNotNull())
    place = F.row_number().over(W.partitionBy(item).orderBy(F.col("score").desc_nulls_last(), profile))
    return rows.select(item, profile, "score", place.alias("place"), "is_member", "matched", "similarity", "breakdown")


def macro_fit(scores: DataFrame, item: str, profile: str, macros: dict[str, list[str]]) -> DataFrame:
    """Mean subscore by macro of each item and profile, to one digit; fields that no macro has are Other. Members and
    profiles that can't be compared have none."""
    table = F.create_map(*(F.lit(x) for m, fields in macros.items() for f in fields for x in (f, m)))
    rows = scores.where("breakdown is not null").select(item, profile, F.explode("breakdown").alias("attribute", "subscore"))
    rows = rows.withColumn("macro", F.coalesce(F.try_element_at(table, F.col("attribute")), F.lit("Other"))).where("subscore is not null")
    return rows.groupBy(item, profile, "macro").agg(half_even(F.round(F.avg("subscore"), 6), 1).alias("fit"), F.count("*").alias("fields"))


def in_bands(ranked: DataFrame, bands: DataFrame, profile: str) -> DataFrame:
    """Ranked rows with band: short, long or other by the profile's length_band (A, C)."""
    rows = ranked.join(bands.select(profile, "length_band"), profile, "left")
    return rows.withColumn("band", F.when(F.col("length_band") == "A", "short").when(F.col("length_band") == "C", "long").otherwise("other")).drop("length_band")


def best_of_latest(scores: DataFrame, tests: DataFrame, item: str, profile: str, newest: str, most: int) -> DataFrame:
    """The best profile of each of the latest tests, newest first (a report: at most `most` rows)."""
    last = tests.orderBy(F.col(newest).desc(), F.col(item).desc()).limit(most)
    rows = scores.join(last, item)
    best = F.row_number().over(W.partitionBy(item).orderBy(F.col("score").desc_nulls_last(), profile))
    return rows.withColumn("_r", best).where("_r = 1").drop("_r")


def shared_valuation(scores: DataFrame, item: str, profile: str, macros: dict[str, list[str]]) -> DataFrame:
    """item, profile, macro, share (of all shared fields that the macro has), scored and total fields."""
    n = sum(map(len, macros.values()))
    rows = scores.select(item, profile, F.map_keys(F.coalesce("breakdown", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))).alias("_k"))
    each = F.array(*(F.struct(F.lit(m).alias("macro"), F.lit(round(100.0 * len(f) / n, 6)).alias("share"), F.size(F.array_intersect("_k", F.array(*map(F.lit, f)))).cast("long").alias("scored"), F.lit(len(f)).cast("long").alias("total")) for m, f in macros.items()))
    return rows.select(item, profile, F.inline(each))
