"""Counts, cards and listings over items, accounts and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """what, n: rows of each table, or its distinct values of a column."""
    parts = [df.agg((F.count("*") if c is None else F.count_distinct(c)).alias("n")).select(F.lit(name).alias("what"), "n") for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def distinct_tags(parts: list[DataFrame], tag: str) -> DataFrame:
    """Tags of several tables without regard to case: the smallest spelling of each, and how often it stands anywhere."""
    rows = parts[0].select(tag)
    for p in parts[1:]:
        rows = rows.union(p.select(tag))
    rows = rows.where(F.trim(F.coalesce(tag, F.lit(""))) != "")
    return rows.groupBy(F.lower(tag).alias("key")).agg(F.min(tag).alias(tag), F.count("*").alias("n")).drop("key")


def tag_index(parts: dict[str, DataFrame], tag: str, account: str) -> DataFrame:
    """kind, tag, account and items: terms and examples of several tables by account."""
    rows = None
    for kind, df in parts.items():
        part = df.select(F.lit(kind).alias("kind"), tag, account)
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("kind", tag, account).agg(F.count("*").alias("items"))


def by_share(rows: DataFrame, group: str) -> DataFrame:
    """n and percent of all rows by group; nulls are a group."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))  # one row a group


def by_subject(profiles: DataFrame, subject: str, subjects: list[str], rest: str = "Unassigned") -> DataFrame:
    """subject, n: profiles of each known subject, also those without any, and of the rest."""
    known = F.when(F.col(subject).isin(*subjects), F.col(subject)).otherwise(rest)
    found = profiles.groupBy(known.alias("subject")).agg(F.count("*").alias("n"))
    names = profiles.sparkSession.createDataFrame([(s,) for s in [*subjects, rest]], "subject string")
    return names.join(found, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("n"))


def production_accounts(videos: DataFrame, account: str, norm: Column, shot: Column, form: Column, at: str) -> DataFrame:
    """account (its smallest spelling), videos, shots, formats, both, last: by normalised name."""
    rows = videos.select(F.col(account).alias("_a"), norm.alias("_n"), shot.alias("_s"), form.alias("_f"), F.col(at).alias("_t"))
    return rows.groupBy("_n").agg(F.min("_a").alias(account), F.count("*").alias("videos"), F.count_if("_s").alias("shots"), F.count_if("_f").alias("formats"), F.count_if(F.col("_s") & F.col("_f")).alias("both"), F.max("_t").alias("last")).drop("_n")


def clips_by_account(clips: DataFrame, styles: DataFrame, account: str, size: str, style: str) -> DataFrame:
    """account, clips, bytes and the styles that use its clips, in order."""
    used = styles.where(F.col(style).isNotNull()).groupBy(account).agg(F.array_join(F.array_sort(F.collect_set(style)), ", ").alias("used_by"))
    return clips.groupBy(account).agg(F.count("*").alias("clips"), F.sum(size).alias("bytes")).join(used, account, "left")


def source_cards(items: DataFrame, platform: Column, link: Column) -> DataFrame:
    return items.groupBy(platform.alias("platform")).agg(F.count("*").alias("items"), F.count_if(F.coalesce(link, F.lit("")) != "").alias("linked"))


def needing_repair(inputs: DataFrame, shots: DataFrame, item: str, seconds: str, end: str) -> DataFrame:
    """Inputs without a duration, with the number of their shots and where the last one ends."""
    ends = shots.groupBy(item).agg(F.count("*").alias("n_shots"), F.max(end).alias("last_end"))
    return inputs.where(F.col(seconds).isNull()).select(item).join(ends, item, "left").select(item, F.coalesce("n_shots", F.lit(0)).alias("n_shots"), "last_end")


def sampled_share(inputs: DataFrame, seconds: str) -> DataFrame:
    return inputs.agg(F.count("*").alias("inputs"), F.count(seconds).alias("sampled"), (100.0 * F.count(seconds) / F.count("*")).alias("percent"))


def section_text(parts: DataFrame, item: str, section: str, order: str, text: str, between: str = "\n") -> DataFrame:
    """The texts of each section of an item in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.where(F.col(text).isNotNull()).groupBy(item, section).agg(F.array_join(F.transform(rows, lambda r: r["t"]), between).alias("content"), F.count("*").alias("parts"))


def spec_totals(beats: DataFrame, spec: str, least: str, most: str) -> DataFrame:
    """runtime (the middles of the beats' ranges, summed) and the fewest and most shots of each spec."""
    return beats.groupBy(spec).agg(F.sum((F.col(least) + F.col(most)) / 2.0).alias("runtime"), F.sum(least).alias("least"), F.sum(most).alias("most"), F.count("*").alias("beats"))


def spec_cost(specs: DataFrame, images: Column, stills: Column, characters: Column, image: float, still: float, character: float) -> DataFrame:
    """Cost of images, reference stills and speech of each spec, and in all."""
    out = specs.withColumns({"image_cost": images * image, "still_cost": stills * still, "speech_cost": characters * character})
    return out.withColumn("total_cost", F.col("image_cost") + F.col("still_cost") + F.col("speech_cost"))


def queued_total(jobs: DataFrame, state: Column, cost: str) -> DataFrame:
    return jobs.agg(F.count_if(state).alias("jobs"), F.coalesce(F.sum(F.when(state, F.col(cost))), F.lit(0.0)).alias("estimate"))


def capacity(profiles: DataFrame, briefs: DataFrame, axes: DataFrame, profile: str) -> DataFrame:
    """Each profile with has_brief, measured axes, and ready (a brief and an axis)."""
    measured = axes.groupBy(profile).agg(F.count("*").alias("axes"))
    brief = briefs.select(profile).distinct().withColumn("_b", F.lit(True))
    out = profiles.join(brief, profile, "left").join(measured, profile, "left")
    out = out.withColumns({"has_brief": F.coalesce("_b", F.lit(False)), "axes": F.coalesce("axes", F.lit(0))}).drop("_b")
    return out.withColumn("ready", F.col("has_brief") & (F.col("axes") > 0))


def media_cards(coverages: dict[str, DataFrame], items: dict[str, DataFrame] | None = None) -> DataFrame:
    """medium, fields, mean percent from the coverage of each medium, and the number of its items where they are given."""
    out = None
    for medium, df in coverages.items():
        part = df.agg(F.count("*").alias("fields"), F.avg("percent").alias("mean_percent")).select(F.lit(medium).alias("medium"), "fields", "mean_percent")
        if items is not None:
            part = part.join(F.broadcast(items[medium].agg(F.count("*").alias("items"))), F.lit(True))  # one row
        out = part if out is None else out.union(part)
    return out


def shared_categories(coverages: dict[str, DataFrame], categories: dict[str, list[str]]) -> DataFrame:
    """category, and the mean percent of its fields in each medium (null where the medium has none of them)."""
    table = F.create_map(*(F.lit(x) for c, fields in categories.items() for f in fields for x in (f, c)))
    out = None
    for medium, df in coverages.items():
        rows = df.withColumn("category", F.try_element_at(table, F.col("attribute"))).where("category is not null")
        part = rows.groupBy("category").agg(F.avg("percent").alias(medium))
        out = part if out is None else out.join(part, "category", "full")
    return out


def profile_coverage(recorded: DataFrame, profile: str, macros: dict[str, list[str]]) -> DataFrame:
    """profile, macro, percent of the macro's fields that the profile's fingerprint has (profile, attribute rows)."""
    have = recorded.groupBy(profile).agg(F.collect_set("attribute").alias("_a"))
    each = F.array(*(F.struct(F.lit(m).alias("macro"), F.size(F.array_intersect("_a", F.array(*map(F.lit, f)))).cast("long").alias("recorded"), F.lit(len(f)).cast("long").alias("fields")) for m, f in macros.items()))
    return have.select(profile, F.inline(each)).withColumn("percent", 100.0 * F.col("recorded") / F.col("fields"))


def newest_items(items: DataFrame, account: str, order: list[str], item: str, k: int = 5) -> DataFrame:
    """account, items, and its k newest items in order (a report of k a group)."""
    newest = W.partitionBy(account).orderBy(*(F.col(c).desc() for c in order), F.col(item).desc())
    top = items.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= k)
    names = top.groupBy(account).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(item).alias("i")))), lambda x: x["i"].cast("string")), ",").alias("newest"))
    return items.groupBy(account).agg(F.count("*").alias("items")).join(names, account)


def listed(rows: DataFrame, filters: list[Column], order: list[Column]) -> DataFrame:
    """Rows that pass all filters, with their place in an order (nulls as empty, ties as they are told apart by the order)."""
    for f in filters:
        rows = rows.where(f)
    return rows.orderBy(*order)


def both_done(rows: DataFrame, first: Column, second: Column, want: str) -> DataFrame:
    """Listing of a two-step production: both, missing (one of the two) or any."""
    if want == "any":
        return rows
    both = F.coalesce(first, F.lit(False)) & F.coalesce(second, F.lit(False))
    return rows.where(both if want == "both" else ~both)


def item_detail(attributes: DataFrame, sections: dict[str, list[str]], chapters: DataFrame, item: str) -> DataFrame:
    """item, attributes by section (in JSON) and chapters with their points, for all items; what is in no section is last.

    attributes: item, attribute, value; chapters: item, chapter, point, text."""
    table = F.create_map(*(F.lit(x) for s, fields in sections.items() for f in fields for x in (f, s)))
    rows = attributes.where("value is not null").withColumn("section", F.coalesce(F.try_element_at(table, F.col("attribute")), F.lit("~other")))
    each = rows.groupBy(item, "section").agg(F.array_sort(F.collect_list(F.struct("attribute", "value"))).alias("fields"))
    told = each.groupBy(item).agg(F.to_json(F.array_sort(F.collect_list(F.struct("section", "fields")))).alias("attributes"))
    points = chapters.groupBy(item, "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "text"))), lambda p: p["text"]).alias("points"))
    nested = points.groupBy(item).agg(F.to_json(F.array_sort(F.collect_list(F.struct("chapter", "points")))).alias("chapters"))
    return told.join(nested, item, "full")
