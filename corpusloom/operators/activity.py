"""Shots, usage, account medians and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import ranking
from corpusloom.sources.staging import staged

#: Seconds below which a shot is very short and short, and beyond which it is long; categories of shots.
LIMITS = (1, 2, 5)
CATEGORIES = ["illustration_panel", "step_card", "narrator_reaction", "map_data_graphic", "cta", "other"]


def shot_attributes(shots: DataFrame, item: str, number: str, seconds: str, category: str, limits: tuple[float, float, float] = LIMITS, categories: list[str] = CATEGORIES) -> DataFrame:
    """Pace and categories of each item's shots. Durations leave out nulls, shares of categories are of all shots; the
    main category is the most frequent, at a tie the one that comes first."""
    rows = shots.withColumns({"_s": F.col(seconds), "_c": F.col(category)})
    timed = lambda cond: 100.0 * F.count_if(cond) / F.count("_s")
    least, short, long = limits
    pace = rows.groupBy(item).agg(
        F.count("*").alias("n_shots"),
        F.avg("_s").alias("mean_s"),
        F.percentile("_s", 0.5).alias("median_s"),
        F.stddev_pop("_s").alias("std_s"),
        timed(F.col("_s") < least).alias("shortest_percent"),
        timed(F.col("_s") < short).alias("short_percent"),
        timed(F.col("_s").between(short, long)).alias("middle_percent"),
        timed(F.col("_s") > long).alias("long_percent"),
        *((100.0 * F.count_if(F.col("_c") == c) / F.count("*")).alias(f"percent_{c}") for c in categories),
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), F.col("_s").alias("s")))).alias("_curve"),
    )
    counts = rows.groupBy(item, "_c").agg(F.count("*").alias("_n"), F.min(number).alias("_first"))
    main = counts.groupBy(item).agg(F.min_by("_c", F.struct(-F.col("_n"), F.col("_first"), F.col("_c"))).alias("main_category"))
    curve = F.array_join(F.transform("_curve", lambda x: x["s"].cast("long").cast("string")), ",")
    return pace.join(main, item).withColumn("curve", curve).drop("_curve")


def gated_median(rows: DataFrame, account: str, metrics: list[str]) -> DataFrame:
    """Median of each metric, null unless half the rows have it, and how many have it."""
    out = []
    for m in metrics:
        out += [F.when(2 * F.count(m) >= F.count("*"), F.percentile(m, 0.5)).alias(m), F.concat(F.count(m).cast("string"), F.lit("/"), F.count("*").cast("string")).alias(f"{m}_coverage")]
    return rows.groupBy(account).agg(*out)


def hot_gated_median(rows: DataFrame, account: str, metrics: list[str]) -> DataFrame:
    """gated_median() for accounts that may hold most of all rows: medians from ranges of ranked values, counts as partial
    sums. Metrics are told one a row in between, and written once. A null account is one account."""
    one = [F.col(m).cast("double").alias(m) for m in metrics]
    values = staged(rows.select(account, *one).unpivot([account], metrics, "_metric", "_value"), "metrics")
    found = ranking.medians(values, [account, "_metric"], "_value")
    wide = found.groupBy(F.col(account).alias("_a")).agg(*(F.max(F.when(F.col("_metric") == m, F.col("median"))).alias(f"_m{i}") for i, m in enumerate(metrics)))
    have = lambda m: F.count(F.when(F.col("_metric") == m, F.col("_value")))
    counts = values.groupBy(account).agg(F.count_if(F.col("_metric") == metrics[0]).alias("_n"), *(have(m).alias(f"_c{i}") for i, m in enumerate(metrics)))
    both = counts.join(wide, F.col(account).eqNullSafe(F.col("_a")), "left")
    out = []
    for i, m in enumerate(metrics):
        share = F.concat(F.col(f"_c{i}").cast("string"), F.lit("/"), F.col("_n").cast("string"))
        out += [F.when(2 * F.col(f"_c{i}") >= F.col("_n"), F.col(f"_m{i}")).alias(m), share.alias(f"{m}_coverage")]
    return both.select(account, *out)


def mode_with_spread(rows: DataFrame, account: str, axis: str, enough: int = 3) -> DataFrame:
    """The most frequent value of an axis (the smaller at a tie), all counts as a note, confirmed from enough rows on."""
    counts = rows.where(F.col(axis).isNotNull()).groupBy(account, axis).agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(axis).alias("v"))))
    out = counts.groupBy(account).agg(order.alias("o"), F.sum("n").alias("n_rows"))
    note = F.array_join(F.transform("o", lambda x: F.concat(x["v"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    return out.select(account, F.get("o", F.lit(0))["v"].alias("value"), note.alias("note"), "n_rows", (F.col("n_rows") >= enough).alias("confirmed"))


def usage(rows: DataFrame, site: str, cost: str, large: Column) -> DataFrame:
    """Calls, mean and total cost by call site and size, with totals by site and over all (rollup)."""
    sized = rows.select(F.col(site).alias("site"), F.when(large, "large").otherwise("usual").alias("size"), F.col(cost).alias("cost"))
    return sized.rollup("site", "size").agg(F.count("*").alias("n"), F.avg("cost").alias("mean_cost"), F.sum("cost").alias("total_cost"))


#: Dollars for a million tokens in and out, and the share of it that a batch call costs.
PRICES, BATCH = (2.0, 10.0), 0.5


def call_cost(tokens_in: Column, tokens_out: Column, batch: Column, prices: tuple[float, float] = PRICES) -> Column:
    """Dollars of a call, to six digits."""
    whole = tokens_in / 1e6 * prices[0] + tokens_out / 1e6 * prices[1]
    return F.round(whole * F.when(batch, BATCH).otherwise(1.0), 6)


def token_usage(calls: DataFrame, site: str, tokens_in: str, tokens_out: str, batch: str, large: int = 5000, prices: tuple[float, float] = PRICES) -> DataFrame:
    """Calls, mean tokens, cost, batch calls and the output's share of the cost by call site and size, with totals."""
    paid = F.when(F.col(batch), BATCH).otherwise(1.0)
    sized = calls.select(
        F.col(site).alias("site"),
        F.when(F.col(tokens_out) > large, "large output").otherwise("usual").alias("size"),
        F.col(tokens_in).alias("i"),
        F.col(tokens_out).alias("o"),
        F.col(batch).alias("b"),
        call_cost(F.col(tokens_in), F.col(tokens_out), F.col(batch), prices).alias("cost"),
        (F.col(tokens_out) / 1e6 * prices[1] * paid).alias("out_cost"),
    )
    totals = sized.rollup("site", "size").agg(F.count("*").alias("n"), F.avg("i").alias("mean_input"), F.avg("o").alias("mean_output"), F.sum("cost").alias("cost"), F.count_if("b").alias("batch_calls"), F.sum("out_cost").alias("_out"))
    return totals.withColumn("output_percent", F.when(F.col("cost") > 0, 100 * F.col("_out") / F.col("cost"))).drop("_out")


def trusted_accounts(items: DataFrame, account: str, classified: Column, least: int = 1) -> DataFrame:
    """Accounts with at least so many classified items."""
    return items.groupBy(account).agg(F.count_if(classified).alias("_n")).where(F.col("_n") >= least).select(account)


def over_budget(calls: DataFrame, at: str, cost: str, cap: float) -> DataFrame:
    """day, spent, over: spending of each UTC day against a cap."""
    return calls.groupBy(F.to_date(at).alias("day")).agg(F.sum(cost).alias("spent")).withColumn("over", F.col("spent") >= cap)


def gate_chain(classified: Column, account: Column, seconds: Column, topic: Column, spent: Column) -> Column:
    """The first reason that holds an item: classified, no account, length, topic, budget; null if none does."""
    return first_reason(F.when(classified, "already_classified"), F.when(account.isNull(), "no_account"), length_gate(seconds), topic, F.when(spent, "over_budget"))


def missing_frames(shots: DataFrame, item: str, number: str, captured: str) -> DataFrame:
    """Items with shots whose frame was not captured, and those shots' numbers in order."""
    lost = F.collect_list(F.when(~F.coalesce(F.col(captured), F.lit(False)), F.col(number)))
    return shots.groupBy(item).agg(F.array_sort(lost).alias("missing")).where(F.size("missing") > 0)


def first_reason(*reasons: Column) -> Column:
    """The first reason of a chain of gates, or null."""
    return F.coalesce(*reasons)


def topic_gate(title: Column, text: Column, keywords: list[str], most_words: int = 600) -> Column:
    """off_topic unless a keyword is a substring of the title or the first words of the text."""
    head = F.array_join(F.slice(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), 1, most_words), " ")
    both = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), head)
    return F.when(~F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(both, k)), "off_topic")


def length_gate(seconds: Column, least: float = 5, most: float = 3600) -> Column:
    return F.when(seconds > most, "too_long").when(seconds < least, "too_short")


def valuation(shares: DataFrame, group: str, weight: str) -> DataFrame:
    """Share of all weight of each group, the largest first, with where it starts and ends in the sum."""
    rows = shares.groupBy(group).agg(F.sum(weight).alias("weight"))
    order = W.orderBy(F.col("share").desc(), group)  # one row a group: small at any input size
    rows = rows.withColumn("share", 100.0 * F.col("weight") / F.sum("weight").over(W.partitionBy()))
    return rows.withColumn("end", F.sum("share").over(order)).withColumn("start", F.col("end") - F.col("share"))


def weighted_sample(rows: DataFrame, group: str, weight: Column, k: int, seed: int, key: str) -> DataFrame:
    """k rows of each group, drawn by weight without replacement (exponential keys of a hash of seed and key)."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = rows.withColumn("_draw", -F.log(unit) / weight)
    # a hot group is cut to k in each slice first
    sliced = W.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("_draw", key)
    cut = drawn.withColumn("_r", F.row_number().over(sliced)).where(F.col("_r") <= k)
    return cut.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("_draw", key))).where(F.col("place") <= k).drop("_draw", "_r")


#: Weights of the kinds of sources, and of drawing one, two or three of them.
KINDS, HOW_MANY = {"term": 0.30, "example": 0.25, "quote": 0.05, "chapter": 0.40}, (0.60, 0.25, 0.15)


def drawn_sources(sources: DataFrame, seekers: DataFrame, key: str, kind: str, item: str, used: DataFrame, seed: int, kinds: dict[str, float] = KINDS, how_many: tuple[float, ...] = HOW_MANY) -> DataFrame:
    """One to three sources for each seeker, of kinds drawn by weight without replacement, one drawn item of each kind.

    Used items (kind and item) are out. The draw is a function of the seed, the seeker and the kind: a kind's items are
    numbered in order and one number is drawn, so a hot kind is never gathered."""
    free = sources.join(used, [kind, item], "left_anti").select(kind, item).distinct()
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    first = F.min_by(item, F.xxhash64(F.lit(seed), item)).alias("_low")
    slices = 64  # a drawn slice, then its first item by hash: even over items for slices of about one size
    slice_of = F.pmod(F.xxhash64(F.lit(seed + 1), item), F.lit(slices))
    table = free.groupBy(kind, slice_of.alias("_slice")).agg(first).groupBy(kind).agg(F.sort_array(F.collect_list("_low")).alias("_items"))
    weight = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    counts = F.lit(len(how_many))
    for n in range(len(how_many), 0, -1):
        counts = F.when(unit(F.lit("n"), key) <= sum(how_many[:n]), n).otherwise(counts)
    names = F.array(*map(F.lit, kinds))
    order = F.array_sort(F.transform(names, lambda k: F.struct((-F.log(unit(F.lit("k"), key, k)) / F.element_at(weight, k)).alias("d"), k.alias("k"))))
    rows = seekers.select(key, counts.alias("_n"), F.posexplode(order).alias("_place", "_x")).select(key, "_n", "_place", F.col("_x.k").alias(kind))
    rows = rows.join(table, kind)
    place = F.row_number().over(W.partitionBy(key).orderBy("_place"))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.col("_n"))
    at = F.floor(unit(F.lit("i"), key, kind) * F.size("_items") - 1e-12).cast("int")
    return rows.select(key, "place", kind, F.get("_items", at).alias(item))


def oldest(rows: DataFrame, waiting: Column, order: list[str]) -> DataFrame:
    """The row that waits longest."""
    return rows.where(waiting).orderBy(*order).limit(1)
