"""Queries of titles, upkeep, timing, views and name matching, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import titles
from corpusloom.functions.scoring import categorical_subscore
from corpusloom.operators import matching, profiles, timing, upkeep, views
from corpusloom.plans.queries import _NORMAL, _PRINTS, _SCORES, SCORED, _even, _feature_ctes, _prints, rounded, table
from corpusloom.sources.staging import staged

VOCABULARY = {"lang": ["en", "fr", "de"], "quality": ["1"], "toxic": ["0", "1"]}
MACROS = {"size": ["n_chars"], "judgement": ["quality", "toxic"]}


def _title(text="text"):
    return F.array_join(F.slice(F.split(T.stripped(F.col(text)), r"\s+"), 1, 5), " ")


def title_formats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _title().alias("title"))
    return docs.select("doc_id", titles.title_format(F.col("title")).alias("format"))


def summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", titles.summary(F.col("text")).alias("summary"), titles.duration_label(F.col("n_chars") / 15.0).alias("duration"))


def ingest_dedup(spark, sf_dir):
    """Documents without a label as a batch against the labelled ones."""
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash")), "hashes")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return upkeep.ingest_status(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi"), "content_hash", "doc_id").select("doc_id", "status")


def upsert_newest(spark, sf_dir):
    """The last event of each user and type before 2024-01-16 updated by those after; purchases there have no value."""
    events = table(spark, sf_dir, "events").withColumn("value", F.when((F.col("ts") < "2024-01-16") | (F.col("event_type") != "purchase"), F.col("value")))
    keys = ["user_id", "event_type"]
    old, new = (upkeep.latest(events.where(c), keys, ["ts", "event_id"], ["event_id", "value"]) for c in ("ts < '2024-01-16'", "ts >= '2024-01-16'"))
    return rounded(upkeep.upsert(old, new, keys, ["event_id"], ["value"]))


def account_merge(spark, sf_dir):
    mapping = spark.sql("select * from values ('src1', 'src0'), ('src2', 'src0'), ('src3', 'src4') t(source, into)")
    docs = upkeep.merge_accounts(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), mapping, "source")
    return rounded(docs.groupBy("source").agg(F.count("*").alias("items"), F.avg("n_chars").alias("mean_chars")))


def account_codes(spark, sf_dir):
    """Codes of sources by language, after the codes that English and German have."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    taken = spark.sql("select * from values ('en', 'en.7'), ('en', 'en.10'), ('de', 'de.2') t(lang, code)")
    return upkeep.next_codes(docs, taken, "lang", "source", "doc_id")


def reply_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return upkeep.vocabulary_errors(docs, "doc_id", VOCABULARY, ("toxic",))


def _shares(spark, sf_dir, where="true"):
    docs = table(spark, sf_dir, "documents").where(where).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profiles.categorical_fingerprint(profiles.long_categorical(docs, ["source"], ["lang", "quality", "toxic"]), "source")


def category_drift(spark, sf_dir):
    """Drift of the shares of each source from its English texts alone to all of its texts."""
    return rounded(profiles.category_drift(_shares(spark, sf_dir), _shares(spark, sf_dir, "lang = 'en'"), "source"))


def top_values(spark, sf_dir):
    return rounded(views.top_values(_shares(spark, sf_dir), "source", 2))


def categorical_scores(spark, sf_dir):
    """Mean categorical subscore of each labelled document for each source: subscores of distinct values are joined."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")
    items = profiles.long_categorical(docs, ["doc_id"], ["lang", "quality", "toxic"])
    shares = _shares(spark, sf_dir)
    recorded = shares.select("source", "attribute").distinct()
    values = items.select("attribute", "value").distinct().join(recorded, "attribute")
    subs = values.join(shares.select("source", "attribute", "value", "share"), ["source", "attribute", "value"], "left")
    subs = subs.withColumn("subscore", F.round(categorical_subscore(F.col("share"), F.lit(True)), 1))
    return rounded(items.join(subs, ["attribute", "value"]).groupBy("doc_id", "source").agg(F.avg("subscore").alias("score"), F.count("*").alias("n_attributes")))


def characteristic_profiles(spark, sf_dir):
    return views.extremes(rounded(_prints(spark, sf_dir)), "source")


def macro_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(views.by_macro(profiles.coverage(docs, ["n_chars", "quality", "toxic"]), MACROS))


def account_roster(spark, sf_dir):
    """Customers, those with orders and users with events, by number."""
    parts = {n: table(spark, sf_dir, n).select(F.col(c).alias("account")) for n, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))}
    return views.roster(parts, "account")


def account_progress(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    parts = [labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id")]
    return rounded(views.progress(table(spark, sf_dir, "documents").select("doc_id", "source"), parts, "source", "doc_id"))


def library_listing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("account"), F.size(T.words(T.stripped(F.col("text")))).cast("long").alias("words"), F.lower(_title()).alias("title"))
    page = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.size(T.words(page)).cast("long").alias("words"), F.lower(page).alias("title"))
    return views.listing({"text": docs, "page": pages}, [F.col("title").contains("en"), F.col("words").between(5, 300)])


def production_stages(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"))
    second = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), "o_orderkey", "o_orderdate")
    third = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return views.stages(first, second, third, "account", "o_orderkey", ["o_orderdate"])


def assembly_plan(spark, sf_dir):
    """Shots of orders' lines: as many as between 1 and the line's number, over its quantity in seconds."""
    lines = table(spark, sf_dir, "lineitem").withColumn("least", F.lit(1))
    return rounded(timing.assembly_plan(lines, "l_orderkey", "l_linenumber", "least", "l_linenumber", "l_quantity"))


def even_frames(spark, sf_dir):
    return timing.even_frames(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 2, 500)


def _videos(spark, sf_dir):
    """Documents as videos: each sentence is a cue, each twentieth begins a chapter."""
    docs = table(spark, sf_dir, "documents").withColumn("s", T.sentences(T.stripped(F.col("text"))))
    cues = F.transform("s", lambda x, i: F.struct((i * 5.0).alias("start"), x.alias("text")))
    none = F.array().cast("array<string>")
    firsts = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), x.alias("title"), F.get(F.col("s"), i + 1).alias("summary"), none.alias("points"))), lambda c: c["i"] % 20 == 0)
    return docs.select("doc_id", cues.alias("cues"), firsts.alias("sections"), (F.size("s") * 5.0).alias("duration"))


def chapter_times(spark, sf_dir):
    rows = timing.chapter_times(_videos(spark, sf_dir), "doc_id").select("doc_id", F.posexplode("times").alias("chapter", "t"))
    return rows.select("doc_id", "chapter", "t.start", "t.end", "t.method", "t.confidence")


def marked_transcripts(spark, sf_dir):
    return _videos(spark, sf_dir).select("doc_id", timing.marked_transcript(F.col("cues")).alias("transcript"))


def host_names(spark, sf_dir):
    """Hosts of secure pages resolved against those of the others."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract(F.coalesce("url", F.lit("")), "^(https?)://", 1).alias("scheme"), F.regexp_extract(F.coalesce("url", F.lit("")), "^https?://([^/?]+)", 1).alias("host")).where("host <> ''")
    known, incoming = (hosts.where(F.col("scheme") == s).select("host") for s in ("http", "https"))
    return matching.resolve_names(incoming, known, "host", F.regexp_replace(F.lower("host"), "[^a-z0-9]", ""))


def title_match(spark, sf_dir):
    """For each text to score the page whose title has the likest set of words."""
    texts = matching.word_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, [])
    page = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    pages = matching.word_rows(table(spark, sf_dir, "pages").select("page_id", page.alias("title")), "page_id", "title", 3, [])
    return rounded(matching.set_match(texts, pages, "item_id", "page_id"))


def rewrite_deltas(spark, sf_dir):
    """Scores of the first half of each text beside those of the whole text, for each profile."""
    prints = staged(_prints(spark, sf_dir), "prints")  # both scores read them
    texts = table(spark, sf_dir, "benchmark").select("item_id", "text")
    half = texts.withColumn("text", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    pre, post = (rounded(profiles.score(profiles.long_numeric(T.core_features(d), ["item_id"], SCORED), prints, "item_id", "source")) for d in (texts, half))
    return rounded(views.deltas(pre, post, ["item_id", "source"]))


_ALL = (title_formats, summaries, ingest_dedup, upsert_newest, account_merge, account_codes, reply_errors, category_drift, top_values, categorical_scores, characteristic_profiles, macro_coverage, account_roster, account_progress, library_listing, production_stages, assembly_plan, even_frames, chapter_times, marked_transcripts, host_names, title_match, rewrite_deltas)
QUERIES = {f.__name__: f for f in _ALL}

# ---- SQL ----

_STRIPPED = r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')"
_TITLE = rf"array_to_string(string_split_regex({_STRIPPED}, '\s+')[1:5], ' ')"
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
_PAGE_TITLE = "regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)"


def _opens(words: list[str]) -> str:
    return "regexp_matches(t, '(?i)^(" + "|".join(words).replace("'", "''") + f"){_EDGE_R}')"


def _has(words: list[str]) -> str:
    return f"regexp_matches(t, '(?i){_EDGE_L}(" + "|".join(words).replace("'", "''") + f"){_EDGE_R}')"


def _short(text: str, most: int) -> str:
    return f"case when length({text}) > {most} then regexp_replace(left({text}, {most}), ' [^ ]*$', '') || '…' else {text} end"


_COMMON = "(" + ", ".join(f"'{a}'" for a in titles.COMMON_ACRONYMS) + ")"
_LABELLED = "(select source, lang, quality::varchar quality, toxic::varchar toxic, doc_id from documents left join labels using (doc_id))"
_VALUES = "lateral (values ('lang', lang), ('quality', quality), ('toxic', toxic)) x(attribute, value)"


def _shares_sql(name: str, where: str = "true") -> str:
    return f"""{name}_c as (select source, x.attribute, x.value, count(*) n from {_LABELLED} d, {_VALUES} where x.value is not null and {where} group by all),
        {name} as (select *, {_even('100.0 * n / sum(n) over (partition by source, attribute)', 1)} share from {name}_c)"""


ORACLE_SQL = {
    "title_formats": rf"""with d as (select doc_id, {_TITLE} t from documents), h as (select *, trim(regexp_extract(t, '^([^,:]*)[,:]', 1)) head, regexp_extract(t, '^[^,:]*([,:])', 1) mark from d)
        select doc_id, case when t = '' then null when lower(t) = 'untitled' then 'Untitled/Missing' when ends_with(t, '?') then 'Question' when regexp_matches(t, '^\d+\s') then 'Numbered List'
            when {_opens(["how\\s+to"])} then 'How-To / Instructional' when {_opens(titles.SECOND_PERSON)} then 'Second-Person Callout' when {_opens(titles.COMMANDS)} then 'Command / Imperative'
            when mark <> '' and regexp_full_match(head, '[A-Z]{{2,6}}') and head not in {_COMMON} then 'Framework / Acronym Label'
            when mark = ',' then 'Name/Source + Concept' when mark = ':' then 'Topic/Concept: Elaboration' when {_has(titles.SUPERLATIVES)} then 'Superlative / Ranking'
            when regexp_matches(t, '{_EDGE_L}([A-Z][a-z]+\s[A-Z][a-z]+|(19|20)\d\d){_EDGE_R}') then 'Named Example / Case Study'
            when {_opens(["the", "this"])} then 'Curiosity Gap / Teaser' when {_opens(titles.QUESTION_WORDS)} then 'Question (implied)'
            when len(list_filter(string_split_regex(t, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}') and x not in {_COMMON})) > 0 then 'Framework / Acronym Label'
            when len(string_split_regex(t, '\s+')) <= 4 then 'Concept Label (Unattributed)' when {_has(titles.COPULAS)} then 'Declarative Claim' else 'Other' end format from h""",
    "summaries": rf"""with d as (select doc_id, n_chars, list_filter(string_split(regexp_replace(trim(replace({_STRIPPED}, chr(10), ' ')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') s from documents),
        e as (select *, {_STRIPPED.replace("text", "s[1]")} a, {_STRIPPED.replace("text", "s[len(s)]")} z, round_even(n_chars / 15.0, 0)::bigint q from d)
        select doc_id, case when len(s) = 0 then '—' when len(s) = 1 then {_short("a", 220)} else {_short("a", 110)} || ' […] ' || {_short("z", 110)} end summary, (q // 60) || ':' || lpad((q % 60)::varchar, 2, '0') duration from e""",
    "ingest_dedup": f"""with h as (select doc_id, sha256({_NORMAL}) k, doc_id in (select doc_id from labels) l from documents), f as (select k, min(doc_id) filter (not l) first, bool_or(l) known from h group by k)
        select doc_id, case when known then 'in_corpus' when doc_id > first then 'in_batch' else 'inserted' end status from h join f using (k) where not l""",
    "upsert_newest": """with e as (select * replace (case when ts < '2024-01-16' or event_type <> 'purchase' then value end as value), ts >= '2024-01-16' late from events),
        r as (select * from e qualify row_number() over (partition by user_id, event_type, late order by ts desc, event_id desc) = 1),
        o as (select * from r where not late), n as (select * from r where late)
        select user_id, event_type, coalesce(n.event_id, o.event_id) event_id, round(coalesce(n.value, o.value), 6) as value, case when o.event_id is null then 'inserted' when n.event_id is not null then 'updated' else 'kept' end change
        from o full join n using (user_id, event_type)""",
    "account_merge": "select case source when 'src1' then 'src0' when 'src2' then 'src0' when 'src3' then 'src4' else source end source, count(*) items, round(avg(n_chars), 6) mean_chars from documents group by 1",
    "account_codes": """with s as (select lang, source, min(doc_id) f from documents group by all)
        select lang, source, lang || '.' || (case lang when 'en' then 10 when 'de' then 2 else 0 end + row_number() over (partition by lang order by f, source)) code from s""",
    "reply_errors": f"""with e as (select doc_id, list_filter([case when lang is null then 'missing lang' when lang not in ('en', 'fr', 'de') then 'invalid lang: ' || lang end,
            case when quality is null then 'missing quality' when quality <> '1' then 'invalid quality: ' || quality end, case when toxic not in ('0', '1') then 'invalid toxic: ' || toxic end], lambda x: x is not null) e from {_LABELLED})
        select doc_id, len(e)::bigint n_errors, array_to_string(e, '; ') errors from e""",
    "category_drift": f"""with {_shares_sql("a")}, {_shares_sql("b", "lang = 'en'")}
        select source, attribute, round(sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2, 6) distance from a full join b using (source, attribute, value) group by all""",
    "top_values": f"""with {_shares_sql("a")}, r as (select source, attribute, value, n, share, row_number() over (partition by source, attribute order by share desc, value)::int place from a)
        select source, attribute, value, n, round(share, 6) share, place from r where place <= 2""",
    "categorical_scores": f"""with {_shares_sql("a")}, i as (select doc_id, x.attribute, x.value from {_LABELLED} d, {_VALUES} where x.value is not null and doc_id in (select doc_id from labels)),
        p as (select distinct source, attribute from a)
        select doc_id, source, round(avg(round(20 + 0.8 * coalesce(share, 0), 1)), 6) score, count(*) n_attributes from i join p using (attribute) left join a using (source, attribute, value) group by all""",
    "characteristic_profiles": _feature_ctes("documents") + _PRINTS + ", q as (select source, attribute, round(mean, 6) mean from pr), top as (select attribute, max(mean) mean from q group by all) select attribute, mean, min(source) source, count(*) tied from q join top using (attribute, mean) group by all",
    "macro_coverage": """with p as (select 'size' macro, 100.0 * count(n_chars) / count(*) p from documents union all select 'judgement', 100.0 * count(quality) / count(*) from documents left join labels using (doc_id)
            union all select 'judgement', 100.0 * count(toxic) / count(*) from documents left join labels using (doc_id))
        select macro, count(*) fields, round(avg(p), 6) mean_percent, count(*) filter (p >= 99.9) "full", count(*) filter (p = 0) empty from p group by macro""",
    "account_roster": """with r as (select c_custkey account, 1 c, 0 o, 0 e from customer union all select o_custkey, 0, 1, 0 from orders union all select user_id, 0, 0, 1 from events),
        s as (select account, sum(c)::bigint customer_items, sum(o)::bigint orders_items, sum(e)::bigint events_items from r group by account)
        select *, (customer_items > 0)::int in_customer, (orders_items > 0)::int in_orders, (events_items > 0)::int in_events, (customer_items > 0)::int + (orders_items > 0)::int + (events_items > 0)::int n_sections from s""",
    "account_progress": """with d as (select source, doc_id in (select doc_id from labels where quality = 1 or toxic = 1) a from documents)
        select source, count(*) items, count(*) filter (a) analysed, round(100.0 * count(*) filter (a) / count(*), 6) percent, bool_and(a) complete from d group by source""",
    "library_listing": rf"""with r as (select doc_id id, lang account, len(regexp_extract_all({_STRIPPED}, '[A-Za-z'']+'))::bigint words, lower({_TITLE}) title, 'text' kind from documents
            union all select page_id, null, len(regexp_extract_all({_PAGE_TITLE}, '[A-Za-z'']+'))::bigint, lower({_PAGE_TITLE}), 'page' from pages)
        select * from r where contains(title, 'en') and words between 5 and 300""",
    "production_stages": """with s as (select o_custkey account, o_orderkey, count(*) over (partition by o_custkey) n_second from orders where o_custkey is not null qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
        select coalesce(c_custkey, account) account, o_orderkey, coalesce(n_second, 0) n_second, c_custkey is not null has_first,
            case when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 'third' when o_orderkey is not null then 'second' else 'first' end stage from customer full join s on c_custkey = account""",
    "assembly_plan": """with b as (select l_orderkey, l_linenumber, l_quantity, greatest(1, round_even((1 + l_linenumber) / 2.0, 0)::int) n, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_quantity rows between unbounded preceding and 1 preceding), 0) f from lineitem),
        s as (select *, unnest(range(1, n + 1))::int shot from b)
        select l_orderkey, l_linenumber, shot, round(l_quantity / n, 6) shot_s, round(f + (shot - 1) * (l_quantity / n), 6) start_s, case when n = 1 then 'only' when shot = 1 then 'first' when shot = n then 'last' else 'middle' end as role from s""",
    "even_frames": """with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 i, greatest(1, count(*) over (partition by l_orderkey) // 2) s from lineitem)
        select l_orderkey, l_linenumber from r where i % s = 0 and i // s < 2 order by l_orderkey desc, l_linenumber limit 500""",
    "title_match": f"""with a as (select distinct item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')) word from benchmark), b as (select distinct page_id, unnest(regexp_extract_all(lower({_PAGE_TITLE}), '[a-z]{{4,}}')) word from pages),
        na as (select item_id, count(*) x from a group by all), nb as (select page_id, count(*) y from b group by all),
        m as (select item_id, page_id, count(*) / (any_value(x) + any_value(y) - count(*)) j from a join b using (word) join na using (item_id) join nb using (page_id) group by item_id, page_id)
        select item_id, page_id, round(j, 6) jaccard from m qualify row_number() over (partition by item_id order by j desc, page_id) = 1""",
    "rewrite_deltas": f"""with pre as ({_SCORES} select item_id, source, score from sc), post as ({_SCORES.replace("from benchmark)", "from (select item_id, substr(text, 1, length(text) // 2) text from benchmark) half)")} select item_id, source, score from sc)
        select item_id, source, post.score as after, pre.score as before, round(post.score - pre.score, 1) + 0.0 delta from post left join pre using (item_id, source)""",
}
