"""Queries of the classification round trip, upkeep of shots and profiles, counts, cards and listings, with SQL that gives
the same rows in DuckDB. The given tables stand for the library's, as in studio."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import titles
from corpusloom.operators import activity, cards, catalog, profiles, replies, timing, upkeep
from corpusloom.plans.queries import _PRINTS, SCORED, _even, _feature_ctes, _features, _features_once, _prints, rounded, table
from corpusloom.plans.studio import _SHARE_CTES, _classed, _shares

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- replies ----

ALLOWED = {"lang": ["en", "fr", "de"], "source": [f"src{i}" for i in range(12)]}
_CHECKED = "case when lang is null then 'missing lang' when lang not in ('en', 'fr', 'de') then 'invalid lang: ' || lang end, case when source is null then 'missing source' when not regexp_matches(source, '^src([0-9]|1[01])$') then 'invalid source: ' || source end"


@query("select doc_id, 'Classify ' || coalesce(source, '') || ' (' || coalesce(lang, '') || ')' prompt from documents left join labels using (doc_id) where quality is null")
def work_queue(spark, sf_dir):
    """Documents without a label, each with its prompt."""
    return replies.work_queue(_classed(spark, sf_dir), "doc_id", F.col("quality").isNull(), "Classify %s (%s)", ["source", "lang"])


def _raw_replies(spark, sf_dir) -> DataFrame:
    """Replies made of documents: a fenced array, a bare object, prose around a fence, no JSON at all."""
    one = F.to_json(F.struct("lang", "source", F.lit("x").alias("extra")))
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("```json\n["), one, F.lit(","), one, F.lit("]\n```"))).when(kind == 1, one).when(kind == 2, F.concat(F.lit("# Analysis\n```\n"), one, F.lit("\n```\nDone"))).otherwise("no json here")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("reply"))


@query("""select doc_id, case doc_id % 4 when 0 then 2 when 3 then 0 else 1 end::bigint n_objects, doc_id % 4 < 3 valid, case when doc_id % 4 < 3 then lang end lang, case when doc_id % 4 < 3 then source end source from documents""")
def parsed_replies(spark, sf_dir):
    rows = replies.parsed_replies(_raw_replies(spark, sf_dir), "doc_id", "reply", ["lang", "source"])
    first = F.get("items", F.lit(0))
    return rows.select("doc_id", "n_objects", "valid", F.try_element_at(first, F.lit("lang")).alias("lang"), F.try_element_at(first, F.lit("source")).alias("source"))


@query(r"""select conv_id, turn, case when turn % 3 = 0 then role else '' end title, trim(coalesce(text, ''), ' ') script, turn % 3 = 0 and coalesce(role, '') <> '' and trim(coalesce(text, ''), ' ') <> '' valid from conversations""")
def title_and_script(spark, sf_dir):
    """Turns of conversations as replies; every third names a title."""
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("TITLE: "), F.coalesce("role", F.lit("")), F.lit("\n"))).otherwise("")
    rows = table(spark, sf_dir, "conversations").withColumns({"reply": F.concat(head, F.lit("SCRIPT: "), F.coalesce("text", F.lit(""))), "id": F.struct("conv_id", "turn")})
    return replies.title_and_script(rows, "id", "reply").select("id.*", "title", "script", "valid")


@query(f"""with d as (select doc_id, lang, source, quality, array_to_string(list_filter([{_CHECKED}], lambda e: e is not null), '; ') errors from documents left join labels using (doc_id))
        select doc_id, case when quality is null or errors <> '' then 'old' else lang end lang, case when quality is null or errors <> '' then null else source end source,
            case when quality is null then 'pending' when errors = '' then 'model' else 'needs_review' end status, case when quality is null then 'before' when errors <> '' then errors end error from d""")
def merged_replies(spark, sf_dir):
    """Labelled documents as replied to: their language and source fill the fields of pending items."""
    docs = _classed(spark, sf_dir)
    items = docs.select("doc_id", F.lit("old").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit("pending").alias("status"), F.lit("before").alias("error"))
    got = docs.where("quality is not null").select("doc_id", "lang", "source")
    return replies.merge_replies(items, got, "doc_id", ["lang", "source"], ALLOWED)


@query(f"""with d as (select doc_id, array_to_string(list_filter([{_CHECKED}], lambda e: e is not null), '; ') errors from documents)
        select doc_id, case when errors = '' then 'accepted' else 'needs_review' end status, case when errors <> '' then errors end reason from d""")
def routed_replies(spark, sf_dir):
    checked = upkeep.vocabulary_errors(table(spark, sf_dir, "documents"), "doc_id", ALLOWED)
    accepted, review = replies.routed(checked)
    return accepted.select("doc_id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason")).union(review.select("doc_id", "status", "reason"))


@query("""with d as (select conv_id, count(*) n, count(*) filter (role = 'user') sections, count(*) filter (role = 'user' and trim(coalesce(text, '')) = '') blank, count(*) filter (role = 'assistant' and trim(coalesce(text, '')) = '') empty, min(role) kind from conversations group by all),
        e as (select conv_id, list_filter([case when kind is null then 'missing kind' when kind not in ('assistant', 'user') then 'invalid kind: ' || kind end, case when sections = 0 then 'no sections' when blank > 0 then 'section without title' end, case when empty > 0 then 'example without text' end], lambda x: x is not null) errors from d)
        select conv_id, len(errors)::bigint n_errors, array_to_string(errors, '; ') errors from e""")
def book_reply_errors(spark, sf_dir):
    """Conversations as book replies: user turns are sections, assistant turns examples."""
    pick = lambda role, name: F.collect_list(F.when(F.col("role") == role, F.struct(F.col("text").alias(name))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("role").alias("kind"), pick("user", "title").alias("sections"), pick("assistant", "text").alias("examples"))
    return replies.book_reply_errors(rows, "conv_id", {"kind": ["assistant", "user"]})


@query("select event_id, event_type, case event_type when 'click' then 'a' else 'b' end as value from events where event_type in ('click', 'view') and case event_type when 'click' then 'a' else 'b' end = 'a'")
def axis_readings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "click", "a").otherwise("b"))
    return replies.axis_readings(rows, "event_id", "event_type", "value", {"click": ["a", "c"], "view": ["a"]})


_FORMAT = """fi as (select doc_id, source, case when lang = 'en' then 'same' when lang = 'de' then 'differs' end text_audio_relation, case when n_chars % 5 = 0 then 'promotional' when n_chars % 5 < 4 then 'editorial' end segment_kind from documents),
        fr as (select doc_id, x.axis, x.value from documents, lateral (values ('length', case when n_chars < 500 then 'short' when n_chars < 5000 then 'middle' else 'endless' end), ('voice', lang)) x(axis, value) where (axis = 'length' and value in ('short', 'middle')) or (axis = 'voice' and value in ('en', 'fr'))),
        fa as (select fi.*, coalesce(segment_kind = 'promotional', false)::int excluded, case when segment_kind = 'promotional' then 'Promotional segment: selling, not editorial style.' end exclusion_reason, coalesce(axes, 0) axes, case when axes > 0 then 'classified' else 'needs_review' end status from fi left join (select doc_id, count(*) axes from fr group by all) using (doc_id))"""


def _format_parts(spark, sf_dir):
    """Documents as inputs of an account (their source): relation by language, kind by length, two axes of readings."""
    docs = table(spark, sf_dir, "documents")
    relation = F.when(F.col("lang") == "en", " Same ").when(F.col("lang") == "de", "differs").otherwise("maybe")
    kind = F.when(F.col("n_chars") % 5 == 0, "Promotional").when(F.col("n_chars") % 5 < 4, "editorial").otherwise("ad")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("endless")
    rows = docs.select("doc_id", F.inline(F.array(F.struct(F.lit("length").alias("axis"), size.alias("value")), F.struct(F.lit("voice").alias("axis"), F.col("lang").alias("value")))))
    readings = replies.axis_readings(rows, "doc_id", "axis", "value", {"length": ["short", "middle"], "voice": ["en", "fr"]})
    return readings, replies.read_inputs(docs.select("doc_id", relation.alias("relation"), kind.alias("kind")), "doc_id", "relation", "kind", readings)


@query(f"with {_FORMAT} select doc_id, text_audio_relation, segment_kind, excluded, exclusion_reason, axes, status from fa")
def format_inputs(spark, sf_dir):
    return _format_parts(spark, sf_dir)[1]


@query(f"""with {_FORMAT}, us as (select doc_id, source from fa where status = 'classified' and excluded = 0), si as (select source, count(*) n_inputs from us group by all),
        co as (select source, axis, value, count(*) n from fr join us using (doc_id) group by all), best as (select *, sum(n) over (partition by source, axis)::bigint "of", row_number() over (partition by source, axis order by n desc, value) r from co)
        select source, axis, value, n, "of", n_inputs, case when n_inputs >= 3 then 'confirmed' else 'preliminary' end status from best join si using (source) where r = 1""")
def format_profiles(spark, sf_dir):
    readings, inputs = _format_parts(spark, sf_dir)
    inputs = inputs.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return replies.format_profiles(readings, inputs, "doc_id", "source", "axis", "value")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag in ('A', 'N') then l_returnflag else 'other' end replaced,
        coalesce(case when l_linestatus = 'F' then 'kept' end, case when l_returnflag in ('A', 'N') then l_returnflag end, 'other') filled from lineitem""")
def shot_categories(spark, sf_dir):
    """Return flags as new categories, of which two are known; lines of status F have one already."""
    old = F.when(F.col("l_linestatus") == "F", "kept")
    new = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", replies.shot_category(new, old, ["A", "N"]).alias("replaced"), replies.shot_category(new, old, ["A", "N"], fill=True).alias("filled"))


@query("""select 'unlabelled documents' what, count(*) n from documents where doc_id not in (select doc_id from labels where doc_id is not null) union all select 'toxic documents', count(*) from labels where toxic = 1
        union all select 'failed events', count(*) from events where event_type = 'error' union all select 'open orders', count(*) from orders where o_orderstatus = 'O' union all select 'pages without text', count(*) from pages where coalesce(html, '') = ''""")
def attention_inbox(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    waiting = {
        "unlabelled documents": docs.join(labels, "doc_id", "left_anti"),
        "toxic documents": labels.where("toxic = 1"),
        "failed events": table(spark, sf_dir, "events").where("event_type = 'error'"),
        "open orders": table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"),
        "pages without text": table(spark, sf_dir, "pages").where("coalesce(html, '') = ''"),
    }
    return replies.attention(waiting)


# ---- shots, profiles, accounts ----


@query("select l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') missing from lineitem where l_returnflag = 'R' group by all")
def missing_frames(spark, sf_dir):
    """Lines that came back are shots without a frame."""
    rows = activity.missing_frames(table(spark, sf_dir, "lineitem").withColumn("captured", F.col("l_returnflag") != "R"), "l_orderkey", "l_linenumber", "captured")
    return rows.select("l_orderkey", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


_LINES = "(select l_orderkey k, l_linenumber n, l_linenumber * 10.0::double start_sec, l_linenumber * 10.0::double + 10 end_sec from lineitem)"
_LENGTHS = "(select o_orderkey k, case when o_orderkey % 9 > 0 then (o_orderkey % 75) * 1.0::double + 0.1 end as secs from orders)"


def _lines(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), (n * 10.0).alias("start_sec"), (n * 10.0 + 10).alias("end_sec"))


def _lengths(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 9 > 0, (k % 75) * 1.0 + 0.1).alias("seconds"))


@query(f"""with l as (select k, max(n) n, max(end_sec) e from {_LINES} group by k)
        select k, n, start_sec, end_sec from {_LINES} union all select k, l.n + 1, l.e, o.secs from l join {_LENGTHS} o using (k) where o.secs - l.e > 0.15""")
def closing_shots(spark, sf_dir):
    """Lines as shots of ten seconds, orders with a made-up length."""
    return upkeep.with_closing_shot(_lines(spark, sf_dir), _lengths(spark, sf_dir), "k", "n", "start_sec", "end_sec", "seconds")


@query("""with w as (select l_orderkey from lineitem group by all having bool_and(l_returnflag <> 'R')), n as (select distinct o_orderkey from orders where o_orderkey % 2 = 0)
        select l_orderkey, l_linenumber, 'stored' origin from lineitem where l_orderkey in (select l_orderkey from w) or l_orderkey not in (select o_orderkey from n)
        union all select o_orderkey, 1, 'new' from orders where o_orderkey % 2 = 0 and o_orderkey not in (select l_orderkey from w)""")
def reingested_shots(spark, sf_dir):
    """Even orders come again with one shot each."""
    stored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("captured"), F.lit("stored").alias("origin"))
    new = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(True).alias("captured"), F.lit("new").alias("origin"))
    return upkeep.reingested_shots(stored, new, "l_orderkey", "captured").drop("captured")


@query(f"""select k, coalesce(secs, e) as "seconds" from {_LENGTHS} o left join (select k, max(end_sec) e from {_LINES} group by k) l using (k)""")
def repaired_durations(spark, sf_dir):
    ends = _lines(spark, sf_dir).select("k", F.col("end_sec").alias("last_end"))
    return upkeep.repaired_durations(_lengths(spark, sf_dir), ends, "k", "seconds")


@query(f"select k, count(n) n_shots, max(end_sec) last_end from {_LENGTHS} o left join {_LINES} l using (k) where secs is null group by k")
def inputs_needing_repair(spark, sf_dir):
    return catalog.needing_repair(_lengths(spark, sf_dir), _lines(spark, sf_dir), "k", "seconds", "end_sec")


@query(f"select count(*) inputs, count(secs) sampled, round(100.0 * count(secs) / count(*), 6) percent from {_LENGTHS}")
def sampled_share(spark, sf_dir):
    return rounded(catalog.sampled_share(_lengths(spark, sf_dir), "seconds"))


@query("""with p as (select source, lang, count(*) n from documents where source is not null and lang is not null group by all), m(source, target) as (values ('src1', 'src0'), ('src2', 'src0'), ('src3', 'src4')),
        t as (select * from p where source not in (select source from m)), v as (select m.target, p.* from p join m using (source) where not exists (select 1 from t where t.source = m.target and t.lang = p.lang))
        select source, lang, n from t union all select target, lang, n from v qualify row_number() over (partition by target, lang order by source) = 1""")
def merged_profiles(spark, sf_dir):
    """Counts by source and language as profiles; src1 and src2 are merged into src0, src3 into src4."""
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    mapping = spark.sql("select * from values ('src1', 'src0'), ('src2', 'src0'), ('src3', 'src4') t(source, into)")
    return upkeep.merge_profiles(rows, mapping, "source", "lang")


@query("select distinct s source from (select unnest([source, case when doc_id % 40 = 3 then 'src9' else source end]) s from documents where doc_id % 40 = 3 and source is distinct from 'src9') where s is not null")
def touched_accounts(spark, sf_dir):
    """Accounts to rebuild after each fortieth document was given to src9."""
    before = table(spark, sf_dir, "documents").select("doc_id", "source")
    after = before.withColumn("source", F.when(F.col("doc_id") % 40 == 3, "src9").otherwise(F.col("source")))
    return upkeep.touched_accounts(before, after, "doc_id", "source")


@query("""with g as (select o_orderkey k from orders where o_orderstatus = 'F')
        select 'lines' what, count(*) n, 0::bigint blank from lineitem where l_orderkey not in (select k from g) union all select 'events', count(*), count(*) filter (user_id is null or user_id in (select k from g)) from events""")
def removed_items(spark, sf_dir):
    """Finished orders are removed: their lines go, events that name their number lose it."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    tables = upkeep.remove_with_children(gone, "k", {"lines": table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")}, {"events": table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")})
    lines = tables["lines"].agg(F.count("*").alias("n")).select(F.lit("lines").alias("what"), "n", F.lit(0).cast("long").alias("blank"))
    return lines.union(tables["events"].agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("blank")).select(F.lit("events"), "n", "blank"))


@query("""with p as (select page_id, case when l like '%instagram.com%' then 'Instagram' when l like '%youtube.com%' or l like '%youtu.be%' then 'YouTube' when l like '%facebook.com%' or l like '%fb.watch%' then 'Facebook' when l like '%tiktok.com%' then 'TikTok' else 'Web' end right_one, case when page_id % 3 > 0 then 'Web' else 'Instagram' end wrong from (select *, lower(coalesce(url, '')) l from pages))
        select page_id, wrong as "old", right_one as "new" from p where wrong <> right_one""")
def repaired_media(spark, sf_dir):
    """Pages with a made-up media type against what their links say: the dry run."""
    pages = table(spark, sf_dir, "pages").withColumn("media", F.when(F.col("page_id") % 3 > 0, "Web").otherwise("Instagram"))
    return upkeep.repaired_media(pages, "page_id", "media", T.platform(F.col("url")))


@query(_feature_ctes("documents") + _PRINTS + """, o as (select source, attribute, count(*) n, avg(value) mean from fl where lang = 'en' group by all), re(source) as (values ('src0'), ('src1'), ('gone'))
        select source, attribute, n, round(mean, 6) mean from pr where source not in (select source from re) union all select source, attribute, n, round(mean, 6) from o where source in (select source from re)""")
def replaced_profiles(spark, sf_dir):
    """src0 and src1 are rebuilt from their English texts alone."""
    cols = ["source", "attribute", "n", "mean"]
    new = profiles.numeric_fingerprint(profiles.long_numeric(_features(spark, sf_dir).where("lang = 'en'"), ["source"], SCORED), "source")
    rebuilt = spark.sql("select * from values ('src0'), ('src1'), ('gone') t(source)")
    return rounded(upkeep.replace_profiles(_prints(spark, sf_dir).select(*cols), new.select(*cols), rebuilt, "source"))


@query(_feature_ctes("documents") + _PRINTS + " select source, attribute, round(mean, 6) mean, s.id snapshot_id, s.label from pr, (values (1::bigint, 'first'), (2::bigint, 'second')) s(id, label)")
def profile_snapshots(spark, sf_dir):
    prints = _prints(spark, sf_dir, _features_once(spark, sf_dir)).select("source", "attribute", "mean")
    none = prints.where("false").withColumns({"snapshot_id": F.lit(0).cast("long"), "label": F.lit(""), "at": F.lit("").cast("timestamp")})
    at = F.lit("2024-01-01").cast("timestamp")
    return rounded(upkeep.snapshot(prints, upkeep.snapshot(prints, none, "first", at), "second", at).drop("at"))


# ---- counts ----


@query("select 'documents' what, count(*) n from documents union all select 'sources', count(distinct source) from documents union all select 'customers', count(*) from customer union all select 'languages', count(distinct lang) from documents")
def dashboard_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return catalog.counts({"documents": (docs, None), "sources": (docs, "source"), "customers": (table(spark, sf_dir, "customer"), None), "languages": (docs, "lang")})


@query("with t as (select p_type t from part union all select lower(p_type) from part union all select c_mktsegment from customer) select min(t) tag, count(*) n from t where trim(coalesce(t, '')) <> '' group by lower(t)")
def distinct_tags(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    return catalog.distinct_tags([part.select(F.col("p_type").alias("tag")), part.select(F.lower("p_type").alias("tag")), customer.select(F.col("c_mktsegment").alias("tag"))], "tag")


@query("select 'part' kind, p_type tag, p_brand account, count(*) items from part group by all union all select 'customer', c_mktsegment, c_nationkey::varchar, count(*) from customer group by all")
def tag_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("tag"), F.col("p_brand").alias("account"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tag"), F.col("c_nationkey").cast("string").alias("account"))
    return catalog.tag_index({"part": part, "customer": customer}, "tag", "account")


@query("select lang, count(*) n, round(round(100.0 * count(*) / sum(count(*)) over (), 9), 1) percent from documents group by lang")
def items_by_medium(spark, sf_dir):
    return catalog.by_share(table(spark, sf_dir, "documents"), "lang")


@query("with s(subject) as (values ('en'), ('de'), ('pt'), ('Unassigned')), d as (select case when lang in ('en', 'de', 'pt') then lang else 'Unassigned' end subject, count(*) n from documents group by all) select subject, coalesce(n, 0) n from s left join d using (subject)")
def items_by_subject(spark, sf_dir):
    return catalog.by_subject(table(spark, sf_dir, "documents"), "lang", ["en", "de", "pt"])


@query("""with v as (select 'Account ' || case when o_orderkey % 2 = 0 then '#' else '' end || o_custkey account, o_custkey k, o_totalprice > 100000 s, o_orderstatus = 'F' f, o_orderdate d from orders)
        select min(account) account, count(*) videos, count(*) filter (s) shots, count(*) filter (f) formats, count(*) filter (s and f) as both, max(d)::timestamp as last from v group by k""")
def production_accounts(spark, sf_dir):
    """Orders as videos; an account's name is spelt in two ways."""
    name = F.concat(F.lit("Account "), F.when(F.col("o_orderkey") % 2 == 0, "#").otherwise(""), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").withColumn("account", name)
    return catalog.production_accounts(rows, "account", T.handle(F.col("account")), F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", "o_orderdate")


@query("""with u as (select source, array_to_string(list_sort(list_distinct(list(lang))), ', ') used_by from documents where lang is not null and source is not null group by source)
        select source, count(*) clips, sum(n_chars)::bigint bytes, any_value(used_by) used_by from documents left join u using (source) group by source""")
def clips_by_account(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return catalog.clips_by_account(docs, docs, "source", "n_chars", "lang")


@query("select case when page_id % 2 = 0 then 'even' else 'odd' end platform, count(*) items, count(*) filter (coalesce(url, '') <> '') linked from pages group by all")
def source_cards(spark, sf_dir):
    return catalog.source_cards(table(spark, sf_dir, "pages"), F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd"), F.col("url"))


@query("select conv_id, role, string_agg(text, chr(10) order by turn, text) content, count(*) parts from conversations where text is not null group by all")
def section_content(spark, sf_dir):
    return catalog.section_text(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")


_SPECS = "select l_orderkey, round(sum((l_linenumber + l_quantity) / 2.0), 6) runtime, sum(l_linenumber)::bigint least, round(sum(l_quantity), 6) most, count(*) beats from lineitem group by all"


def _specs(spark, sf_dir) -> DataFrame:
    return catalog.spec_totals(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query(_SPECS)
def spec_totals(spark, sf_dir):
    return rounded(_specs(spark, sf_dir))


@query(f"with s as ({_SPECS}) select *, round(most * 0.04, 6) image_cost, round(beats * 0.02, 6) still_cost, round(runtime * 15 * 0.0003, 6) speech_cost, round(most * 0.04 + beats * 0.02 + runtime * 15 * 0.0003, 6) total_cost from s")
def spec_cost(spark, sf_dir):
    return rounded(catalog.spec_cost(_specs(spark, sf_dir), F.col("most"), F.col("beats"), F.col("runtime") * 15, 0.04, 0.02, 0.0003))


@query("select count(*) filter (o_orderstatus = 'O') jobs, round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0.0), 2) estimate from orders")
def queued_total(spark, sf_dir):
    out = catalog.queued_total(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", "o_totalprice")
    return out.withColumn("estimate", F.round("estimate", 2))


@query("""with a as (select user_id k, count(*) axes from events group by all) select c_custkey, c_custkey in (select o_custkey from orders) has_brief, coalesce(axes, 0) axes, c_custkey in (select o_custkey from orders) and coalesce(axes, 0) > 0 ready from customer left join a on k = c_custkey""")
def capacity(spark, sf_dir):
    """Customers as profiles; orders are briefs, events measured axes."""
    of = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("c_custkey"))
    return catalog.capacity(of("customer", "c_custkey"), of("orders", "o_custkey"), of("events", "user_id"), "c_custkey")


_COVER = "select x.attribute, 100.0 * count(x.value) / count(*) percent from (select n_chars::double n_chars, quality::double quality, toxic::double toxic from documents left join labels using (doc_id)), lateral (values ('n_chars', n_chars), ('quality', quality), ('toxic', toxic)) x(attribute, value) group by all"
_COVER2 = "select x.attribute, 100.0 * count(x.value) / count(*) percent from (select length(html)::double n_chars, case when page_id % 2 = 0 then 1.0::double end quality from pages), lateral (values ('n_chars', n_chars), ('quality', quality)) x(attribute, value) group by all"


def _coverages(spark, sf_dir) -> dict[str, DataFrame]:
    pages = table(spark, sf_dir, "pages").select(F.length("html").alias("n_chars"), F.when(F.col("page_id") % 2 == 0, 1.0).alias("quality"))
    return {"text": profiles.coverage(_classed(spark, sf_dir), ["n_chars", "quality", "toxic"]), "page": profiles.coverage(pages, ["n_chars", "quality"])}


@query(f"select 'text' medium, count(*) fields, round(avg(percent), 6) mean_percent from ({_COVER}) union all select 'page', count(*), round(avg(percent), 6) from ({_COVER2})")
def media_cards(spark, sf_dir):
    return rounded(catalog.media_cards(_coverages(spark, sf_dir)))


@query(f"""with c(attribute, category) as (values ('n_chars', 'size'), ('quality', 'judgement'), ('toxic', 'judgement')), a as (select category, avg(percent) as "text" from ({_COVER}) join c using (attribute) group by all), b as (select category, avg(percent) page from ({_COVER2}) join c using (attribute) group by all)
        select category, round("text", 6) as "text", round(page, 6) page from a full join b using (category)""")
def shared_categories(spark, sf_dir):
    return rounded(catalog.shared_categories(_coverages(spark, sf_dir), {"size": ["n_chars"], "judgement": ["quality", "toxic"]}))


@query(f"""with {_SHARE_CTES}, a as (select distinct source, attribute from sh), m(macro, field) as (values ('class', 'lang'), ('class', 'quality'), ('other', 'toxic'), ('other', 'missing'))
        select s.source, macro, count(a.attribute) recorded, 2::bigint fields, round(100.0 * count(a.attribute) / 2, 6) percent from (select distinct source from sh) s cross join m left join a on a.source is not distinct from s.source and a.attribute = m.field group by all""")
def profile_coverage(spark, sf_dir):
    return rounded(catalog.profile_coverage(_shares(spark, sf_dir).select("source", "attribute"), "source", {"class": ["lang", "quality"], "other": ["toxic", "missing"]}))


@query("""with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc nulls last, doc_id desc) r from documents)
        select source, count(*) items, string_agg(doc_id::varchar, ',' order by r) filter (r <= 5) newest from r where source is not null group by source""")
def newest_items(spark, sf_dir):
    """The five longest documents of each source, as if length were their age."""
    return catalog.newest_items(table(spark, sf_dir, "documents").where("source is not null"), "source", ["n_chars"], "doc_id")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice >= 1000")
def order_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return catalog.listed(rows, [F.col("o_orderstatus") == "O", F.col("o_totalprice") >= 1000], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_totalprice > 100000 shot, o_orderstatus = 'F' form from orders where not (o_totalprice > 100000 and o_orderstatus = 'F')")
def production_listing(spark, sf_dir):
    """Orders that miss one of two steps."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("shot"), (F.col("o_orderstatus") == "F").alias("form"))
    return catalog.both_done(rows, F.col("shot"), F.col("form"), "missing")


# ---- titles, usage, cards ----

@query(f"""with c as (select *, case when o > 5000 then 'large output' else 'usual' end size, round((i / 1e6 * 2.0 + o / 1e6 * 10.0) * case when b then 0.5 else 1.0 end, 6) cost, o / 1e6 * 10.0 * case when b then 0.5 else 1.0 end oc from (select event_type site, trunc(value * 10)::bigint i, event_id % 9000 o, event_type = 'purchase' b from events where value is not null))
        select site, size, count(*) n, round(avg(i), 6) mean_input, round(avg(o), 6) mean_output, round(sum(cost), 6) cost, count(*) filter (b) batch_calls, round(case when sum(cost) > 0 then 100 * sum(oc) / sum(cost) end, 6) output_percent from c group by rollup (site, size)""")
def token_usage(spark, sf_dir):
    """Events as calls: ten times their value tokens in, their number modulo 9000 tokens out, purchases in batches."""
    calls = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("site"), (F.col("value") * 10).cast("long").alias("i"), (F.col("event_id") % 9000).alias("o"), (F.col("event_type") == "purchase").alias("b"))
    return rounded(activity.token_usage(calls, "site", "i", "o", "b"))


@query("select page_id, case when t <> '' then len(regexp_extract_all(t, '[A-Za-z'']+'))::bigint end title_word_count, case when contains(t, ',') then 1 else 0 end title_names_source from (select page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) t from pages)")
def title_features(spark, sf_dir):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in T.title_features(title).items()))


@query("""with s as (select o_orderkey, floor(o_totalprice / 10)::bigint s from orders)
        select o_orderkey, case when s < 3600 then lpad((s // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else (s // 3600)::varchar || ':' || lpad((s // 60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') end stamp, s back from s""")
def time_stamps(spark, sf_dir):
    """Stamps of made-up seconds, and the seconds read back from them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", titles.stamp_of(F.floor(F.col("o_totalprice") / 10)).alias("stamp"))
    return rows.withColumn("back", titles.seconds_of(F.col("stamp")))


def _told(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {_even(x, digits)})"


@query(_feature_ctes("documents") + _PRINTS + f""", w as (select source, max(mean) filter (attribute = 'avg_sentence_len') m, max(mean) filter (attribute = 'lexical_diversity') c, max(mean) filter (attribute = 'word_count') b from pr group by all)
        select source, '~' || {_told("m", 1)} || ' words/sentence on average, ' || case when c < 0.5 then 'tight/consistent' else 'loose/varied' end || ' rhythm (CV ' || {_told("c", 2)} || ').' rhythm,
            '~' || {_told("b", 1)} || ' paragraphs, ' || case when c < 0.9 then 'ends smaller than it started' when c > 1.1 then 'ends bigger than it started' else 'roughly even paragraph sizes' end || ' (closing paragraph is ' || {_told("c", 2)} || 'x the mean paragraph length).' shape from w""")
def style_texts(spark, sf_dir):
    """Lexical diversity stands for the rhythm's variation and the paragraph ratio, words for paragraphs."""
    wide = cards.wide_prints(_prints(spark, sf_dir), _shares(spark, sf_dir), "source", ["avg_sentence_len", "lexical_diversity", "word_count"], ["lang"])
    m, c, b = (F.col(f"mean_{a}") for a in ("avg_sentence_len", "lexical_diversity", "word_count"))
    return wide.select("source", cards.sentence_rhythm(m, c).alias("rhythm"), cards.paragraph_shape(c, b).alias("shape"))


@query(_feature_ctes("documents") + _PRINTS + """, d(source, field, declared, attribute) as (values ('src0', 'sentence_rhythm', '12', 'avg_sentence_len'), ('src1', 'sentence_rhythm', 'short', 'avg_sentence_len'), ('src2', 'vocabulary', '0.5', 'lexical_diversity'), ('none', 'vocabulary', '1', 'lexical_diversity'), ('src0', 'tone', '3', null))
        select d.source, field, declared, round(mean, 6) observed, round(round(try_cast(declared as double) - mean, 9), 3) delta from d left join pr on pr.source = d.source and pr.attribute = d.attribute""")
def card_deltas(spark, sf_dir):
    declared = spark.sql("select * from values ('src0', 'sentence_rhythm', '12'), ('src1', 'sentence_rhythm', 'short'), ('src2', 'vocabulary', '0.5'), ('none', 'vocabulary', '1'), ('src0', 'tone', '3') t(source, field, declared)")
    return rounded(cards.card_deltas(declared, _prints(spark, sf_dir), "source", {"sentence_rhythm": "avg_sentence_len", "vocabulary": "lexical_diversity"}))


@query("""with w as (select source, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+')) word from documents), b(source, word) as (values ('src0', 'the'), ('src0', 'and'), ('src1', 'the'), ('src2', 'zzz'))
        select source, word, count(distinct doc_id) items, count(*) uses from w join b using (source, word) group by all""")
def banned_uses(spark, sf_dir):
    banned = spark.sql("select * from values ('src0', 'The'), ('src0', 'and'), ('src1', 'the'), ('src2', 'zzz') t(source, word)")
    return cards.banned_uses(table(spark, sf_dir, "documents"), banned, "source", "doc_id", "text")


@query(_feature_ctes("documents") + _PRINTS + f""", {_SHARE_CTES}, tp as (select source, string_agg(value || ' (' || {_told('share', 1)} || '%)', ', ' order by share desc, value) t from (select * from sh where attribute = 'lang' qualify row_number() over (partition by source order by share desc, value) <= 3) group by source),
        w as (select source, max(median) filter (attribute = 'word_count') wm, max(low) filter (attribute = 'word_count') wl from pr group by all)
        select item_id, source, source || ': ' || coalesce({_told('wm', 1)}, '(not yet classified)') || ' words, from ' || coalesce({_told('wl', 1)}, '(not yet classified)') || ', in ' || coalesce(t, '(not yet classified)') || ' | ' || length(text) brief from (select item_id, text, 'src' || (item_id % 20) source from benchmark) b join w using (source) left join tp using (source)""")
def rewrite_briefs(spark, sf_dir):
    """Benchmark passages as texts to rewrite in the style of a source."""
    wide = cards.wide_prints(_prints(spark, sf_dir), _shares(spark, sf_dir), "source", ["word_count"], ["lang"])
    texts = table(spark, sf_dir, "benchmark").select("item_id", "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    out = cards.rewrite_brief(texts, wide, "source", F.length("text").cast("string"), "%2$s: %3$s words, from %4$s, in %5$s | %1$s", ["median_word_count", "low_word_count", "top_lang"])
    return out.select("item_id", "source", "brief")


@query("""with m as (select user_id, quantile_cont(value, 0.5) v from events where user_id is not null group by all)
        select user_id, case when v is not null then case when v > 70 then 'mostly static frames' when v > 45 then 'a mix of held and moving shots' else 'near-constant movement' end end movement, case when v is not null then case when v / 30 > 2 then 'it breathes' else 'it runs with almost no gaps' end end speech,
            case when v is not null then case when v / 10 > 5 then 'wide, with light and shade' else 'compressed and constant' end end dynamics, case when v is not null then case when v * 2 > 140 then 'bright, high-key' when v * 2 < 95 then 'dark and moody' else 'mid-key' end end brightness, case when v is not null then case when v * 3 > 180 then 'long form' else 'short form' end end length from m""")
def feel_labels(spark, sf_dir):
    """Users' median values, scaled, as measured metrics."""
    rows = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(F.percentile("value", 0.5).alias("v"))
    v = F.col("v")
    told = cards.feel_labels({"pct_near_still": v, "pct_quiet": v / 30, "loudness_range_lu": v / 10, "mean_luma": v * 2, "duration_sec": v * 3})
    return rows.select("user_id", *(c.alias(n) for n, c in told.items()))


@query(_feature_ctes("documents") + _PRINTS + f""", {_SHARE_CTES} select source, attribute, 0 kind, 'mean ' || {_told('mean', 2)} || ' (' || {_told('low', 2)} || ' to ' || {_told('high', 2)} || ')' told from pr union all select source, attribute, 1, value || ' ' || {_told('share', 1)} || '%' from sh""")
def fingerprint_report(spark, sf_dir):
    return cards.fingerprint_report(_prints(spark, sf_dir), _shares(spark, sf_dir), "source").drop("by")


@query()
def item_details(spark, sf_dir):
    """Documents with their fields by section, and conversations of the same number as chapters."""
    fields = profiles.long_categorical(_classed(spark, sf_dir), ["doc_id"], ["lang", "source", "quality"])
    chapters = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.coalesce("role", F.lit("")).alias("chapter"), F.col("turn").alias("point"), "text")
    return catalog.item_detail(fields, {"origin": ["lang", "source"]}, chapters, "doc_id")


@query()
def drawn_sources(spark, sf_dir):
    """Brands as seekers, types of parts as kinds; parts of size 1 are used."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("item"), "p_brand", "p_size")
    return activity.drawn_sources(part, part.select("p_brand").distinct(), "p_brand", "kind", "item", part.where("p_size = 1").select("kind", "item"), 11, {"ECONOMY": 0.3, "STANDARD": 0.25, "PROMO": 0.05, "SMALL": 0.4})


@query("select o_orderkey, o_orderdate::timestamp o_orderdate from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 1")
def oldest_queued(spark, sf_dir):
    return activity.oldest(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderdate")


@query("select c_custkey, count(o_orderkey) items, count(o_orderkey) filter (o_orderstatus = 'F') done, round(100.0 * count(o_orderkey) filter (o_orderstatus = 'F') / count(o_orderkey), 6) percent from customer join orders on o_custkey = c_custkey group by all having count(o_orderkey) filter (o_orderstatus = 'F') > 0 and count(o_orderkey) > count(o_orderkey) filter (o_orderstatus = 'F')")
def account_listing(spark, sf_dir):
    """Customers whose orders are finished in part."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("items"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").withColumn("percent", F.round(100.0 * F.col("done") / F.col("items"), 6))
    return catalog.listed(rows, [F.col("done") > 0, F.col("done") < F.col("items")], [F.col("percent").desc(), F.col("c_custkey")])


@query("""with h as (select doc_id from labels where quality = 1 union select doc_id from labels where toxic = 1 union select conv_id from conversations where role = 'user')
        select doc_id, lang from documents where doc_id in (select doc_id from h)""")
def items_with_parts(spark, sf_dir):
    """Documents that any of three child tables names."""
    labels = table(spark, sf_dir, "labels")
    parts = [labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"), table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"))]
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(parts[0].union(parts[1]).union(parts[2]).distinct(), "doc_id", "left_semi")


@query("""select 'text' kind, doc_id id, null::varchar part, n_chars size from documents where n_chars <= 500 union all select 'chapter', conv_id, role, sum(length(coalesce(text, '')))::bigint from conversations group by conv_id, role having sum(length(coalesce(text, ''))) > 0""")
def rewrite_inputs(spark, sf_dir):
    """Short documents, and conversations' turns by role as chapters that have content."""
    docs = table(spark, sf_dir, "documents").where("n_chars <= 500").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("part"), F.col("n_chars").alias("size"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size")).where("size > 0")
    return docs.union(turns.select(F.lit("chapter"), "conv_id", "role", "size"))


@query("select c.*, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity)::int place from (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_returnflag = 'A') c")
def reference_clips(spark, sf_dir):
    """Lines that were sent back as clips of suppliers, in the order of source and start."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_suppkey", *order)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)))


@query(f"""with b as (select conv_id, turn, coalesce(role, '') title, list_filter(string_split(coalesce(text, ''), '. '), lambda x: x <> '') captions, case when turn % 2 = 0 then [role] else [] end tags,
            length(coalesce(text, '')) / 20.0::double lo, length(coalesce(text, '')) / 10.0::double hi, (turn % 3)::int smin, (turn % 5)::int smax, case when conv_id % 2 = 0 then 0.4615::double end bs from conversations),
        c as (select *, case when smin <> 0 or smax <> 0 then greatest(1, round_even((smin + case when smax = 0 then smin else smax end) / 2, 0)::int) else greatest(len(captions), 1) end n, (lo + hi) / 2 len from b),
        d as (select *, case when len > 0 then {_even("len / n", 2)} end even from c),
        e as (select *, case when bs is not null and even <> 0 then {_even("greatest(1.0::double, round_even(even / bs, 0)) * bs", 3)} else even end sec from d),
        x as (select *, unnest(range(n)) i from e),
        y as (select *, case when len(captions) > 0 then captions[least(len(captions) - 1, i * len(captions) // n) + 1] else title end subject, row_number() over (partition by conv_id order by turn, i) shot, count(*) over (partition by conv_id) total from x),
        z as (select *, lag(subject) over (partition by conv_id order by turn, i) bf from y)
        select conv_id, turn, shot::int shot, sec as "seconds", subject, tags[i + 1] caption, case when i = 0 and text_of <> '' then text_of end voiceover, case when shot = 1 then 'opening' when shot = total then 'closing' else 'middle' end as role, case when bf <> subject then bf end previous
        from z join (select conv_id, turn, coalesce(text, '') text_of from conversations) using (conv_id, turn)""")
def shot_plans(spark, sf_dir):
    """Conversations as items, turns as beats: their sentences are captions, their lengths seconds; even ones have a tempo."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("title"),
        F.filter(F.split(t, "[.] "), lambda x: x != "").alias("captions"),
        F.when(F.col("turn") % 2 == 0, F.array("role")).alias("tags"),
        F.when(t != "", F.array(t)).alias("lines"),
        (F.length(t) / 20.0).alias("sec_min"),
        (F.length(t) / 10.0).alias("sec_max"),
        (F.col("turn") % 3).cast("int").alias("shot_min"),
        (F.col("turn") % 5).cast("int").alias("shot_max"),
        timing.tempo(F.when(F.col("conv_id") % 2 == 0, 80), F.lit(130.0)).alias("beat_sec"),
    )
    return timing.shot_plan(rows, "conv_id", "turn")
