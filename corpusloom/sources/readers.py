"""Readers of transcripts, books, subtitles, shot lists, timelines, frames and usage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, stripped
from corpusloom.functions.titles import cue_seconds


def transcripts(spark: SparkSession, path: str, channel: str | None = None, platform: str | None = None) -> DataFrame:
    """CSV with Title and Script; rows without a script are left out.

    URL, Duration, PostedAt and ChapterCount are typed where the file has them (null otherwise, and for anything that is
    no number or time); chapter_count and has_chapters follow from the last."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = {"Title", "Script"} - set(rows.columns)
    if missing:
        raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
    rows = rows.withColumns({"Title": stripped(F.col("Title")), "Script": stripped(F.col("Script"))})
    rows = rows.where((F.col("Script") != "") & (F.lower("Script") != "nan"))
    has = lambda c: F.nullif(stripped(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    chapters = has("ChapterCount").try_cast("double").cast("long")
    typed = {"url": has("URL"), "duration_sec": has("Duration").try_cast("double"), "posted_at": has("PostedAt").try_cast("timestamp"), "chapter_count": chapters, "has_chapters": has_chapters(chapters)}
    return rows.withColumns(typed | {"channel": F.lit(channel).cast("string"), "platform": F.lit(platform).cast("string")})


def has_chapters(count: Column) -> Column:
    """1 where there are chapters, else 0; null where it isn't known."""
    return F.when(count > 0, 1).when(count.isNotNull(), 0)


def cued_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of title, script, channel, url, duration_sec, chapter_count and cues (start, text); scripts stripped,
    one row a script (the first title)."""
    schema = "title string, script string, channel string, url string, duration_sec double, chapter_count long, cues array<struct<start:double,text:string>>"
    rows = spark.read.schema(schema).json(path).withColumns({"script": stripped(F.col("script")), "title": stripped(F.col("title"))})
    rows = rows.where("script <> ''").withColumns({"content_hash": content_hash(F.col("script")), "has_chapters": has_chapters(F.col("chapter_count"))})
    best = F.min_by(F.struct(*rows.columns), F.struct("title", "url")).alias("r")
    return rows.groupBy(F.col("content_hash").alias("_h")).agg(best).select("r.*")


def shot_lists(spark: SparkSession, path: str) -> DataFrame:
    """url, title, shot_number, start_sec, end_sec, duration_sec from JSON lines of inputs with nested shots.

    The last shot of a list without an end gets the input's duration."""
    schema = "url string, title string, duration_sec double, shots array<struct<shot_number:int,start_sec:double,end_sec:double>>"
    return shot_rows(spark.read.schema(schema).json(path), ["url", "title"], "duration_sec", "shots")


def shot_rows(inputs: DataFrame, keys: list[str], seconds: str, shots: str) -> DataFrame:
    rows = inputs.select(*keys, F.col(seconds).alias("_d"), F.size(shots).alias("_n"), F.posexplode(shots).alias("_i", "s"))
    end = F.coalesce("s.end_sec", F.when(F.col("_i") == F.col("_n") - 1, F.col("_d")))
    rows = rows.select(*keys, "s.shot_number", "s.start_sec", end.alias("end_sec"))
    return rows.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))


#: Measured numbers of a timeline by the part that holds them.
MEASURED = {
    "editing": "n_cuts n_shots cuts_per_min avg_shot_sec median_shot_sec shortest_shot_sec longest_shot_sec pct_cuts_on_a_pause pct_cuts_on_a_beat".split(),
    "rhythm": ["est_bpm"],
    "sound": "integrated_lufs loudness_range_lu true_peak_dbfs n_pauses pct_quiet".split(),
    "movement": "mean max pct_near_still".split(),
    "picture": "mean_luma luma_stdev".split(),
}


def timelines(spark: SparkSession, path: str) -> DataFrame:
    """One flat row a video from JSON lines of nested measurements, keyed by the hash of its link (the newest file's row
    holds; rows without a link are left out), with cut times, pauses and the motion series as arrays."""
    part = lambda p, more="": f"{p} struct<{','.join(f'{f}:double' for f in MEASURED[p])}{more}>"
    schema = f"url string, title string, account string, duration_sec double, {part('editing', ',cut_times:array<double>')}, {part('rhythm')}, {part('sound', ',pauses:array<array<double>>')}, {part('movement', ',series:array<double>')}, {part('picture')}"
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_name").alias("_file"))
    rows = rows.where(F.trim(F.coalesce("url", F.lit(""))) != "")
    named = {"movement.mean": "motion_mean", "movement.max": "motion_max"}
    flat = [F.col(f"{p}.{f}").alias(named.get(f"{p}.{f}", f)) for p, fields in MEASURED.items() for f in fields]
    none = F.array().cast("array<double>")
    arrays = [F.coalesce("editing.cut_times", none).alias("cut_times"), F.coalesce("sound.pauses", F.array().cast("array<array<double>>")).alias("pauses"), F.coalesce("movement.series", none).alias("motion_series")]
    account = F.nullif(F.regexp_replace("account", "^@+", ""), F.lit("")).alias("account")
    flat_rows = rows.select(content_hash(F.col("url")).alias("content_hash"), "url", "title", account, "duration_sec", *flat, *arrays, "_at", "_file")
    best = F.max_by(F.struct(*[c for c in flat_rows.columns if not c.startswith("_")]), F.struct("_at", "_file", F.to_json(F.struct(*[c for c in flat_rows.columns if not c.startswith("_")])))).alias("r")
    return flat_rows.groupBy(F.col("content_hash").alias("_h")).agg(best).select("r.*")


def format_inputs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame of the inputs in JSON lines: header fields, and frame (from 0), at_sec, note."""
    schema = "url string, title string, account string, platform string, frames array<struct<at_sec:double,note:string>>"
    rows = spark.read.schema(schema).json(path).where(F.trim(F.coalesce("url", F.lit(""))) != "")
    return rows.select(content_hash(F.col("url")).alias("content_hash"), "url", "title", "account", "platform", F.posexplode_outer("frames").alias("frame", "_f")).select("*", "_f.*").drop("_f")


def subtitle_manifests(spark: SparkSession, manifest: str, subtitles_path: str) -> DataFrame:
    """url, shortcode, path, text, last_end of the manifest's videos (a JSON array of url and file) whose subtitle file
    names their shortcode; others have no text."""
    code = lambda c: F.regexp_extract(c, r"/(?:p|reel|reels|tv|shorts|v)/([A-Za-z0-9_-]+)", 1)
    rows = spark.read.schema("url string, title string").json(manifest, multiLine=True)
    rows = rows.withColumn("shortcode", F.nullif(code(F.col("url")), F.lit("")))
    files = subtitles(spark, subtitles_path)
    return rows.join(files, "shortcode", "left").select("url", "title", "shortcode", "path", "text", cue_seconds(F.col("last_cue")).alias("last_end"))


def book_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of books from JSON lines: book, page_num, text, has_image; those without text are empty."""
    rows = spark.read.schema("book string, page_num int, text string, has_image boolean").json(path)
    return rows.select("book", "page_num", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("has_image", F.lit(False)).alias("has_image"))


def books(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("full_text"))
    return rows.withColumns({"word_count": F.size(F.array_remove(F.split("full_text", r"\s+"), "")), "status": F.lit("pending")})


BINARY = "path string, modificationTime timestamp, length long, content binary"


def subtitle_text(raw: Column) -> Column:
    """A paragraph for each block of a subtitle file, without cue numbers, timings, the WEBVTT line and tags; null is
    empty."""
    drop = r"^\d+$|-->|^(?i:WEBVTT)$|^$"
    lines = lambda block: F.filter(F.transform(F.split(block, r"\r\n|\n|\r"), lambda x: stripped(x)), lambda x: ~x.rlike(drop))
    bare = lambda block: F.filter(F.transform(lines(block), lambda x: F.regexp_replace(x, r"<[^>]+>|\{[^}]*\}", "")), lambda x: x != "")
    blocks = F.transform(F.split(stripped(raw), r"\n\s*\n"), lambda b: F.array_join(bare(b), " "))
    return F.array_join(F.filter(blocks, lambda p: p != ""), "\n\n")


def subtitles(spark: SparkSession, path: str, at_once: int | None = None) -> DataFrame:
    """path, folder, shortcode, modified, text, last_cue, status of each .srt and .vtt file under a folder, as a batch, or with
    at_once as a stream of the files that come, so many at once.

    A file isn't fatal: bytes that are no UTF-8 are left out and its status is bad_bytes; one without any cue text is no_text, its
    text empty; an empty file has no row. shortcode is the file's name without its endings. A stream takes a file once, under its first content."""
    reader = spark.readStream.option("maxFilesPerTrigger", at_once) if at_once else spark.read
    files = reader.format("binaryFile").schema(BINARY)
    files = files.option("pathGlobFilter", "*.{srt,vtt,SRT,VTT}").option("recursiveFileLookup", "true").load(path)
    told = F.col("content").cast("string")
    valid = F.is_valid_utf8(told)
    raw = F.when(valid, told).otherwise(F.replace(F.make_valid_utf8(told), F.lit("\ufffd"), F.lit("")))
    last = F.try_element_at(F.regexp_extract_all("_raw", F.lit(r"-->\s*((?:\d+:)?\d+:\d+[.,]\d+)"), F.lit(1)), F.lit(-1))
    rows = files.select("path", F.col("modificationTime").alias("modified"), valid.alias("_valid"), raw.alias("_raw"))
    rows = rows.withColumns({"text": subtitle_text(F.col("_raw")), "last_cue": last})
    status = F.when(~F.col("_valid"), "bad_bytes").when(F.col("text") == "", "no_text").otherwise("ok")
    folder, code = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([A-Za-z0-9_-]+)(?:\.[a-z]{2})?\.(?i:srt|vtt)$", 1)
    return rows.select("path", folder.alias("folder"), F.nullif(code, F.lit("")).alias("shortcode"), "modified", "text", "last_cue", status.alias("status"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "ts double, model string, input_tokens long, output_tokens long, estimated_cost_usd double, call_site string, is_batch boolean"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").withColumn("at", F.timestamp_seconds("ts"))
