"""Style cards, briefs and labels that put fingerprints into words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import half_even


def told_number(value: Column, digits: int) -> Column:
    """The number with so many digits, rounded half to even; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", half_even(value, digits)))


def wide_prints(prints: DataFrame, shares: DataFrame, profile: str, numbers: list[str], categories: list[str], k: int = 3) -> DataFrame:
    """One row a profile: mean_, median_, low_, high_ of the named numbers; top_ of the named categories as text."""
    stats = [F.max(F.when(F.col("attribute") == a, F.col(s))).alias(f"{s}_{a}") for a in numbers for s in ("mean", "median", "low", "high")]
    num = prints.groupBy(profile).agg(*stats)
    best = shares.where(F.col("attribute").isin(*categories)).groupBy(profile, "attribute").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("value").alias("v")))), 1, k).alias("top"))
    told = F.array_join(F.transform("top", lambda t: F.concat(t["v"], F.lit(" ("), told_number(-t["s"], 1), F.lit("%)"))), ", ")
    cat = best.groupBy(profile).agg(*(F.max(F.when(F.col("attribute") == c, told)).alias(f"top_{c}") for c in categories))
    return num.join(cat, profile, "left")


def sentence_rhythm(mean: Column, cv: Column) -> Column:
    texture = F.when(cv < 0.5, "tight/consistent").otherwise("loose/varied")
    varied = F.concat(F.lit(", "), texture, F.lit(" rhythm (CV "), told_number(cv, 2), F.lit(")"))
    return F.concat(F.lit("~"), told_number(mean, 1), F.lit(" words/sentence on average"), F.coalesce(varied, F.lit("")), F.lit("."))


def paragraph_shape(ratio: Column, beats: Column) -> Column:
    shape = F.when(ratio < 0.9, "ends smaller than it started").when(ratio > 1.1, "ends bigger than it started").otherwise("roughly even paragraph sizes")
    count = F.coalesce(F.concat(F.lit("~"), told_number(beats, 1), F.lit(" paragraphs, ")), F.lit(""))
    return F.when(ratio.isNotNull(), F.concat(count, shape, F.lit(" (closing paragraph is "), told_number(ratio, 2), F.lit("x the mean paragraph length).")))


def card_deltas(declared: DataFrame, prints: DataFrame, profile: str, attribute_of: dict[str, str]) -> DataFrame:
    """profile, field, declared, observed, delta (declared less observed mean, three digits; null unless a number)."""
    table = F.create_map(*(F.lit(x) for kv in attribute_of.items() for x in kv))
    rows = declared.withColumn("attribute", F.try_element_at(table, F.col("field")))
    rows = rows.join(prints.select(profile, "attribute", F.col("mean").alias("observed")), [profile, "attribute"], "left")
    return rows.select(profile, "field", "declared", "observed", F.round(F.col("declared").try_cast("double") - F.col("observed"), 3).alias("delta"))


def banned_uses(texts: DataFrame, banned: DataFrame, account: str, item: str, text: str) -> DataFrame:
    """account, word, items, uses: how often words that an account bans stand in its own texts (whole words, any case)."""
    words = texts.select(account, item, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0))).alias("word"))
    uses = words.groupBy(account, item, "word").agg(F.count("*").alias("n"))  # before the join: a hot word is one row a text
    return uses.join(banned.select(account, F.lower("word").alias("word")).distinct(), [account, "word"]).groupBy(account, "word").agg(F.count("*").alias("items"), F.sum("n").alias("uses"))


# Kinds of constraints that a style declares.
CONSTRAINTS = ("banned_word", "banned_tone", "banned_format")


def constraints_after(stored: DataFrame, edits: DataFrame, profile: str) -> DataFrame:
    """profile, kind, value after edits (profile, kind, value, action add or remove, edit_id): each value once a profile
    and kind, blanks around it cut off. The last edit of a value holds; unknown kinds, empty values and other actions
    change nothing."""
    key = [profile, "kind", "value"]
    tidy = edits.withColumn("value", F.trim("value")).where(F.col("kind").isin(*CONSTRAINTS) & (F.col("value") != "") & F.col("action").isin("add", "remove"))
    last = tidy.groupBy(*key).agg(F.max_by("action", "edit_id").alias("_action"))
    both = stored.select(*key).distinct().withColumn("_stored", F.lit(True)).join(last, key, "full")
    return both.where(F.coalesce(F.col("_action") == "add", F.col("_stored"))).select(*key)


def constraint_uses(texts: DataFrame, constraints: DataFrame, profile: str, item: str, text: str, tone: str, style: str) -> DataFrame:
    """profile, kind, value, items, uses of every constraint: banned words as whole words of its own texts, banned tones
    and formats as its items' tone and format, all in any case; a constraint that nothing breaks has none."""
    low = constraints.select(profile, "kind", F.lower("value").alias("value")).distinct()
    words = banned_uses(texts, low.where("kind = 'banned_word'").withColumnRenamed("value", "word"), profile, item, text).select(profile, F.lit("banned_word").alias("kind"), F.col("word").alias("value"), "items", "uses")
    told = texts.select(profile, item, F.lower(tone).alias("banned_tone"), F.lower(style).alias("banned_format")).unpivot([profile, item], ["banned_tone", "banned_format"], "kind", "value")
    counts = told.where("value is not null").groupBy(profile, "kind", "value").agg(F.countDistinct(item).alias("items"), F.count("*").alias("uses"))
    return low.join(words.unionByName(counts), [profile, "kind", "value"], "left").fillna(0, ["items", "uses"])


def rewrite_brief(texts: DataFrame, wide: DataFrame, profile: str, text: Column, template: str, fields: list[str]) -> DataFrame:
    """texts (which name a profile) with brief: the template over the text, the profile and fields of wide_prints();
    fields that the profile lacks read (not yet classified)."""
    shown = [F.coalesce(told_number(F.col(f), 1) if t == "double" else F.col(f).cast("string"), F.lit("(not yet classified)")) for f, t in ((f, dict(wide.dtypes)[f]) for f in fields)]
    return texts.join(wide, profile).withColumn("brief", F.format_string(template, text, F.col(profile), *shown))


def feel_labels(f: dict[str, Column]) -> dict[str, Column]:
    """Labels of movement, speech, dynamics, brightness and length from an account's median metrics; null without one."""
    still, quiet, spread, luma, seconds = (f[k] for k in ("pct_near_still", "pct_quiet", "loudness_range_lu", "mean_luma", "duration_sec"))
    known = lambda c, label: F.when(c.isNotNull(), label)
    return {
        "movement": known(still, F.when(still > 70, "mostly static frames").when(still > 45, "a mix of held and moving shots").otherwise("near-constant movement")),
        "speech": known(quiet, F.when(quiet > 2, "it breathes").otherwise("it runs with almost no gaps")),
        "dynamics": known(spread, F.when(spread > 5, "wide, with light and shade").otherwise("compressed and constant")),
        "brightness": known(luma, F.when(luma > 140, "bright, high-key").when(luma < 95, "dark and moody").otherwise("mid-key")),
        "length": known(seconds, F.when(seconds > 180, "long form").otherwise("short form")),
    }


def fingerprint_report(prints: DataFrame, shares: DataFrame, profile: str) -> DataFrame:
    """profile, attribute, told: a line for each number and each value, numbers first, values by share."""
    num = prints.select(profile, F.lit(0).alias("kind"), "attribute", F.lit(0.0).alias("by"), F.format_string("mean %s (%s to %s)", *(told_number(F.col(c), 2) for c in ("mean", "low", "high"))).alias("told"))
    cat = shares.select(profile, F.lit(1).alias("kind"), "attribute", (-F.col("share")).alias("by"), F.concat("value", F.lit(" "), told_number(F.col("share"), 1), F.lit("%")).alias("told"))
    return num.union(cat)
