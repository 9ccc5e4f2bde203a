"""The classification round trip: queue and prompts, tolerant parsing of replies, checks, merges, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of an item that no one has classified.
UNCLASSIFIED = ["auto", "pending", "needs_review"]


def analysed(status: Column, unclassified: list[str] = UNCLASSIFIED) -> Column:
    """True for items with a real classification."""
    return status.isNotNull() & ~status.isin(*unclassified)


def work_queue(items: DataFrame, key: str, missing: Column, template: str, fields: list[str], most: int | None = None) -> DataFrame:
    """key and prompt of the items that still lack a classification, by key; most is the size of a batch.

    template: a printf pattern over the fields (nulls as empty strings)."""
    rows = items.where(missing).select(key, F.format_string(template, *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("prompt"))
    return rows if most is None else rows.orderBy(key).limit(most)


def unfenced(reply: Column) -> Column:
    """The JSON of a reply: what stands in its first code fence, if there is one."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)


def parsed_replies(replies: DataFrame, key: str, reply: str, fields: list[str]) -> DataFrame:
    """key, n_objects, valid and items (array of map<string,string>): an array of objects, or one object as an array.

    A reply that is no JSON has no items and isn't valid. Values that aren't strings come as their JSON; fields that are
    not asked for are left out."""
    text = unfenced(F.col(reply))
    many = F.from_json(text, "array<map<string,string>>", {"mode": "PERMISSIVE"})
    one = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    items = F.when(text.startswith("["), many).when(text.startswith("{"), F.when(one.isNotNull(), F.array(one)))
    items = F.filter(items, lambda m: m.isNotNull())
    asked = F.transform(items, lambda m: F.map_filter(m, lambda k, v: k.isin(*fields)))
    n = F.coalesce(F.size(items), F.lit(0))
    valid = items.isNotNull() & (n > 0)
    return replies.select(key, F.when(valid, n).otherwise(0).cast("long").alias("n_objects"), valid.alias("valid"), F.when(valid, asked).alias("items"))


def title_and_script(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """key, title, script, valid: the parts after TITLE: and SCRIPT:; a reply without either isn't valid."""
    text = F.coalesce(F.col(reply), F.lit(""))
    part = lambda p: F.trim(F.regexp_extract(text, p, 1))
    out = replies.select(key, part(r"(?s)TITLE:[ \t]*([^\n]*)").alias("title"), part(r"(?s)SCRIPT:(.*)").alias("script"))
    return out.withColumn("valid", (F.col("title") != "") & (F.col("script") != ""))


def merge_replies(items: DataFrame, replies: DataFrame, key: str, fields: list[str], allowed: dict[str, list[str]], by: str = "model", optional: tuple[str, ...] = ()) -> DataFrame:
    """items with their fields, status and error after one reply (key and the fields as columns) each.

    A valid reply replaces the fields that it holds, keeps the others, sets status to by and clears the error; a reply
    with a missing or unknown value leaves the fields as they are and sends the item to needs_review with the reason."""
    told = []
    for f in fields:
        v = F.col(f"_n_{f}")
        lacks = F.lit(None).cast("string") if f in optional else F.lit(f"missing {f}")
        told.append(F.when(v.isNull(), lacks).when(~v.isin(allowed[f]), F.concat(F.lit(f"invalid {f}: "), v)) if f in allowed else F.when(v.isNull(), lacks))
    new = replies.select(key, *(F.col(f).cast("string").alias(f"_n_{f}") for f in fields), F.lit(True).alias("_replied"))
    rows = items.join(new, key, "left").withColumn("_errors", F.array_join(F.array_compact(F.array(*told)), "; "))
    good = F.col("_replied") & (F.col("_errors") == "")
    merged = {f: F.when(good, F.coalesce(F.col(f"_n_{f}"), F.col(f).cast("string"))).otherwise(F.col(f).cast("string")) for f in fields}
    state = F.when(good, by).when(F.col("_replied"), "needs_review").otherwise(F.col("status"))
    error = F.when(good, None).when(F.col("_replied"), F.col("_errors")).otherwise(F.col("error"))
    return rows.withColumns(merged | {"status": state, "error": error}).select(*items.columns)


def book_reply_errors(replies: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """key and errors of book replies: fields as in a vocabulary, sections with a title each, examples with a text each."""
    told = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")).when(~F.col(f).isin(v), F.concat(F.lit(f"invalid {f}: "), F.col(f))) for f, v in allowed.items()]
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    told.append(F.when(F.coalesce(F.size("sections"), F.lit(0)) <= 0, "no sections").when(F.exists("sections", lambda s: blank(s["title"])), "section without title"))
    told.append(F.when(F.exists(F.coalesce("examples", F.array().cast(replies.schema["examples"].dataType)), lambda e: blank(e["text"])), "example without text"))
    errors = F.array_compact(F.array(*told))
    return replies.select(key, F.size(errors).cast("long").alias("n_errors"), F.array_join(errors, "; ").alias("errors"))


def routed(checked: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(accepted, review): rows without errors, and the others with status needs_review and the reason."""
    wrong = F.coalesce(F.col(errors), F.lit("")) != ""
    return checked.where(~wrong), checked.where(wrong).withColumns({"status": F.lit("needs_review"), "reason": F.col(errors)})


def axis_readings(readings: DataFrame, key: str, axis: str, value: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Readings of an axis in its vocabulary; others are left out, not turned into a known value."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in vocabulary.items() for x in kv))
    return readings.where(F.array_contains(F.try_element_at(table, F.col(axis)), F.col(value))).select(key, axis, value)


# How text on screen relates to what is said, and kinds of segments.
RELATIONS = ["same", "differs", "no_audio", "no_on_screen_text"]
KINDS = ["editorial", "promotional"]
PROMOTIONAL = "Promotional segment: selling, not editorial style."


def read_inputs(inputs: DataFrame, key: str, relation: str, kind: str, readings: DataFrame) -> DataFrame:
    """key, text_audio_relation and segment_kind (null outside their vocabularies), excluded (1 for promotional segments)
    with its reason, axes (readings in their vocabulary) and status: needs_review for an input without any.

    readings: rows of axis_readings(), which holds the latest reading of an axis once."""
    clean = lambda c, known: F.when(F.lower(F.trim(F.col(c))).isin(known), F.lower(F.trim(F.col(c))))
    rows = inputs.select(key, clean(relation, RELATIONS).alias("text_audio_relation"), clean(kind, KINDS).alias("segment_kind"))
    rows = rows.join(readings.groupBy(key).agg(F.count("*").alias("axes")), key, "left")
    promotional = F.coalesce(F.col("segment_kind") == "promotional", F.lit(False))
    status = F.when(F.coalesce("axes", F.lit(0)) > 0, "classified").otherwise("needs_review")
    return rows.select(key, "text_audio_relation", "segment_kind", promotional.cast("int").alias("excluded"), F.when(promotional, F.lit(PROMOTIONAL)).alias("exclusion_reason"), F.coalesce("axes", F.lit(0)).alias("axes"), status.alias("status"))


def format_profiles(readings: DataFrame, inputs: DataFrame, key: str, account: str, axis: str, value: str, least: int = 3) -> DataFrame:
    """account, axis, value, n, of, n_inputs, status: the most common value of each axis (the smaller at a tie) over the
    inputs that are classified and not excluded; confirmed from so many inputs on.

    inputs: key, account, status, excluded. The counts are made before the shuffle; an account is one row an axis."""
    used = inputs.where("status = 'classified' and excluded = 0").select(key, account)
    size = used.groupBy(account).agg(F.count_distinct(key).alias("n_inputs"))
    counts = readings.join(used, key).groupBy(account, axis, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(account, axis).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b"), F.sum("n").alias("of"))
    status = F.when(F.col("n_inputs") >= least, "confirmed").otherwise("preliminary")
    return best.join(size, account).select(account, axis, f"b.{value}", "b.n", "of", "n_inputs", status.alias("status"))


def shot_category(new: Column, old: Column, allowed: list[str], fill: bool = False) -> Column:
    """The category of a shot: unknown ones are other; with fill, a category that is there stays."""
    known = F.when(new.isin(allowed), new)
    return F.coalesce(old, known, F.lit("other")) if fill else F.coalesce(F.when(new.isNotNull(), F.coalesce(known, F.lit("other"))), old, F.lit("other"))


def attention(counts: dict[str, DataFrame]) -> DataFrame:
    """what, n: how many rows of each kind wait for a person."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
