"""One list over several sections: accounts and their videos by handle and link, and stories over three stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_url, handle


def usable_inputs(inputs: DataFrame, shots: DataFrame, key: str, status: str, captured: str) -> DataFrame:
    """Inputs that a roster offers: classified ones, and others whose shots all have their frame (an input without shots
    lacks none). A missing flag is a missing frame, a missing status is not classified."""
    lacking = shots.where(F.coalesce(F.col(captured).cast("int"), F.lit(0)) == 0).select(key).distinct().withColumn("_lacking", F.lit(True))
    rows = inputs.join(lacking, key, "left")
    return rows.where(F.col("_lacking").isNull() | F.coalesce(F.col(status) == "classified", F.lit(False))).drop("_lacking")


def roster_videos(sections: dict[str, DataFrame]) -> DataFrame:
    """key, link, url, title, at and, for each section, its id and whether it is classified: one row an account and video.

    Each section has id, name, url, title, at, classified. Accounts of different sections are one if their handles are
    equal, videos if their links are after cleaning (hashed); of several rows of a section for one video that of the
    largest id tells. url and title are the first that is known, in the order of the sections and ids; at is the latest.
    Rows without a link are no video. Rows without a name, or of a name without letters and digits, share the empty key."""
    tagged = [
        d.select(F.lit(i).alias("_s"), "id", handle(F.col("name")).alias("key"), F.col("url"), F.nullif(F.col("title"), F.lit("")).alias("title"), F.col("at").cast("string").alias("at"), F.coalesce(F.col("classified").cast("boolean"), F.lit(False)).alias("classified"))
        for i, d in enumerate(sections.values())
    ]
    rows = reduce(DataFrame.unionByName, tagged).where("url is not null and url <> ''").withColumn("link", F.sha2(clean_url(F.col("url")), 256))
    place = F.struct("_s", "id")
    own = lambda i, c: F.max_by(c, F.when(F.col("_s") == i, F.col("id")))
    per = [x for i, s in enumerate(sections) for x in (own(i, F.when(F.col("_s") == i, F.col("id"))).alias(f"{s}_id"), own(i, F.col("classified")).alias(f"{s}_classified"))]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    return rows.groupBy("key", "link").agg(first("url"), first("title"), F.max("at").alias("at"), *per)


def roster_accounts(sections: dict[str, DataFrame], videos: DataFrame, shown: tuple[str, ...], codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """key, display and, for each section, the name there, its code, stored and classified videos; and all videos.

    The name in a section is that of its smallest id. display is the first name in the order of shown, else the key, with
    @ before it. codes may give name and code of profiles for a section: the smallest code of a handle counts, and those
    under shown[0] (the section whose profiles count without any input) add accounts of their own."""
    names = list(sections)
    tagged = [d.select(F.lit(s).alias("_s"), "id", "name", handle(F.col("name")).alias("key"), F.lit(None).cast("string").alias("code")) for s, d in sections.items()]
    held = [d.select(F.lit(s).alias("_s"), F.lit(None).cast(sections[s].schema["id"].dataType).alias("id"), "name", handle(F.col("name")).alias("key"), F.col("code").cast("string").alias("code")) for s, d in (codes or {}).items()]
    rows = reduce(DataFrame.unionByName, tagged + held)
    there = F.col("id").isNotNull() | (F.col("_s") == shown[0])
    told = []
    for s in names:
        mine = F.col("_s") == s
        at = F.when(mine & there & F.col("name").isNotNull(), F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", F.col("id"), F.col("name")))
        told += [F.min_by("name", at).alias(f"{s}_name"), F.min(F.when(mine, F.col("code"))).alias(f"{s}_code")]
    accounts = rows.groupBy("key").agg(F.bool_or(there).alias("_there"), *told).where("_there").drop("_there")
    counts = videos.groupBy("key").agg(F.count("*").alias("videos"), *(x for s in names for x in (F.count(f"{s}_id").alias(f"{s}_stored"), F.count_if(f"{s}_classified").alias(f"{s}_classified"))))
    out = accounts.join(counts, "key", "left").fillna(0, ["videos", *(f"{s}_{w}" for s in names for w in ("stored", "classified"))])
    name = F.coalesce(*(F.nullif(F.col(f"{s}_name"), F.lit("")) for s in shown), F.col("key"))
    return out.withColumn("display", F.when(F.startswith(name, F.lit("@")), name).otherwise(F.concat(F.lit("@"), name)))


def _newest(rows: DataFrame, link: str, key: str) -> DataFrame:
    return rows.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("_of")).agg(F.max(key).alias(key))


def stories(scripts: DataFrame, specs: DataFrame, videos: DataFrame) -> DataFrame:
    """script, spec, video, title, account, at, stage of every story: each script with its newest spec and that one's
    newest video; then specs that no script shows (older ones too) with their newest video; then the videos left over.

    scripts has script, title, account, at; specs has spec, script, title, account, at; videos has video, spec, title, at;
    newest is the largest number. Stage is video where there is one, else shots where there is a spec, else script."""
    newest_spec, newest_video = _newest(specs, "script", "spec"), _newest(videos, "spec", "video")
    clip = newest_video.select(F.col("_of").alias("spec"), "video")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    own = lambda c, word, key: F.coalesce(text(c), F.concat(F.lit(f"{word} #"), F.col(key).cast("string")))
    one = scripts.select("script", own("title", "Script", "script").alias("title"), "account", "at").join(newest_spec.withColumnRenamed("_of", "script"), "script", "left").join(clip, "spec", "left")
    shown = newest_spec.join(scripts.select(F.col("script").alias("_of")), "_of", "left_semi").select("spec")
    two = specs.drop("script").join(shown, "spec", "left_anti").join(clip, "spec", "left").withColumn("script", F.lit(None).cast(scripts.schema["script"].dataType))
    # each spec stands in one of the two lists, so the videos shown are the newest of all specs
    used = newest_video.join(specs.select(F.col("spec").alias("_of")), "_of", "left_semi").select("video")
    three = videos.drop("spec").join(used, "video", "left_anti").withColumn("title", own("title", "Video", "video"))
    cols = ["script", "spec", "video", "title", "account", "at"]
    rows = one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select("video", "title", "at"), allowMissingColumns=True)
    stage = F.when(F.col("video").isNotNull(), "video").when(F.col("spec").isNotNull(), "shots").otherwise("script")
    return rows.select(*cols, stage.alias("stage"))


def story_list(rows: DataFrame, stage: str = "", text: str = "") -> DataFrame:
    """stories() of a stage (any other word: all) whose title or account holds a text, newest first."""
    if stage in ("script", "shots", "video"):
        rows = rows.where(F.col("stage") == stage)
    if text:
        part = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        rows = rows.where(part("title") | part("account"))
    return rows.orderBy(F.col("at").desc_nulls_last(), F.col("script").desc_nulls_last(), F.col("spec").desc_nulls_last(), F.col("video").desc_nulls_last())


def stage_counts(rows: DataFrame) -> DataFrame:
    """One row: stories at each stage and all of them."""
    at: list[Column] = [F.count_if(F.col("stage") == s).alias(s) for s in ("script", "shots", "video")]
    return rows.agg(*at, F.count("*").alias("all"))


def production_creations(creations: DataFrame, inputs: DataFrame, specs: DataFrame, status: str = "", profile: str = "") -> DataFrame:
    """Video creations (creation, title, status, profile, input, spec, made) of a status and profile, newest first, with the
    titles of the input or the spec that each was made from; those of neither stay."""
    rows = creations
    if status:
        rows = rows.where(F.col("status") == status)
    if profile:
        rows = rows.where(F.col("profile") == profile)
    named = lambda t, k, c: t.select(k, F.col("title").alias(c))
    rows = rows.join(named(inputs, "input", "input_title"), "input", "left").join(named(specs, "spec", "spec_title"), "spec", "left")
    cols = ["creation", "title", "status", "profile", "input", "input_title", "spec", "spec_title", "made"]
    return rows.select(*cols).orderBy(F.col("made").desc_nulls_last(), F.col("creation").desc())
