"""Queries of the library list, rosters, stories, moves and hot profiles, with SQL that gives the same rows in DuckDB. The
given tables stand for the library's, as in studio."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import activity, cards, catalog, library, profiles, rosters, scoring, views
from corpusloom.plans import library as base
from corpusloom.plans.queries import SCORED, _features_once, _prints, rounded, table
from corpusloom.plans.studio import _COMPLETE, CATEGORICAL, SHARED, _classed, _profile_table, _shares

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("""with v as (select lang, x.attribute, x.value from documents left join labels using (doc_id), lateral (values ('n_chars', n_chars::double), ('n_words', len(string_split(coalesce(text, ''), ' '))::double), ('quality', quality::double)) x(attribute, value) where x.value is not null)
        select lang, attribute, count(*) n, round(avg(value), 4) mean, round(stddev_pop(value), 4) std, min(value) low, max(value) high, round(quantile_cont(value, 0.5), 4) median from v group by all""")
def hot_fingerprints(spark, sf_dir):
    """Fingerprints of languages: a few profiles that hold all documents."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n_words")  # before the join: no text is shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", words).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = profiles.hot_fingerprint(profiles.long_numeric(docs, ["lang"], ["n_chars", "n_words", "quality"]), "lang")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query("""with v as (select l_linestatus, l_quantity, case when l_linenumber <= 4 then l_discount end l_discount, case when l_linenumber <= 2 then l_tax end l_tax from lineitem),
        g as (select l_linestatus, count(*) n, count(l_quantity) a, count(l_discount) b, count(l_tax) c, quantile_cont(l_quantity, 0.5) x, quantile_cont(l_discount, 0.5) y, quantile_cont(l_tax, 0.5) z from v group by all)
        select l_linestatus, case when 2 * a >= n then round(x, 6) end l_quantity, a || '/' || n l_quantity_coverage, case when 2 * b >= n then round(y, 6) end l_discount, b || '/' || n l_discount_coverage, case when 2 * c >= n then round(z, 6) end l_tax, c || '/' || n l_tax_coverage from g""")
def hot_gated_medians(spark, sf_dir):
    """Medians of an account's metrics where half its rows have them: two accounts that hold all lines."""
    gap = lambda c, n: F.when(F.col("l_linenumber") <= n, F.col(c)).alias(c)
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", gap("l_discount", 4), gap("l_tax", 2))
    return rounded(activity.hot_gated_median(rows, "l_linestatus", ["l_quantity", "l_discount", "l_tax"]))


_ITEMS = """vi as (select doc_id item, 'Text ' || (doc_id % 97) title, source account, case when doc_id % 5 > 0 then lang end own, case when source = 'src1' then 'de' end ps, n_chars words, case doc_id % 3 when 0 then 'Instagram' when 1 then 'YouTube' end media, case doc_id % 4 when 0 then 'question' when 1 then 'list' end title_format from documents),
        bo as (select page_id item, 'Page ' || (page_id % 97) title, 'src' || (page_id % 20) account, case when page_id % 4 = 0 then 'en' end own, case when page_id % 3 = 0 then 'xx' end ps, length(html)::bigint words from pages),
        al as (select 'video' kind, item, title, account, coalesce(ps, own) subject, words, coalesce(media, 'Instagram') media, media raw, title_format, item in (select conv_id from conversations where lower(role) = 'assistant') te, item in (select doc_id from labels where toxic = 1) ex from vi
            union all select 'book', item, title, account, coalesce(own, ps), words, null, null, null, item % 2 = 0, item % 7 = 0 from bo),
        ok as (select kind, item, title, account, case when subject in ('en', 'de') then subject end subject, words, media, title_format, raw, te, ex from al)"""


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict]:
    n, p = F.col("doc_id"), F.col("page_id")
    videos = table(spark, sf_dir, "documents").select(
        n.alias("item"), F.concat(F.lit("Text "), (n % 97).cast("string")).alias("title"), F.col("source").alias("account"), F.when(n % 5 > 0, F.col("lang")).alias("subject"),
        F.when(F.col("source") == "src1", "de").alias("profile_subject"), F.col("n_chars").alias("words"), F.when(n % 3 == 0, "Instagram").when(n % 3 == 1, "YouTube").alias("media"),
        F.when(n % 4 == 0, "question").when(n % 4 == 1, "list").alias("title_format"), n.alias("added"),
    )
    books = table(spark, sf_dir, "pages").select(
        p.alias("item"), F.concat(F.lit("Page "), (p % 97).cast("string")).alias("title"), F.concat(F.lit("src"), (p % 20).cast("string")).alias("account"), F.when(p % 4 == 0, "en").alias("subject"),
        F.when(p % 3 == 0, "xx").alias("profile_subject"), F.length("html").cast("long").alias("words"), p.alias("added"),
    )
    pages = table(spark, sf_dir, "pages")
    tag = lambda rows, key, what: rows.select(F.col(key).alias("item"), what.alias("tag"))
    terms = (tag(table(spark, sf_dir, "conversations"), "conv_id", F.upper("role")), tag(pages.where("page_id % 2 = 0"), "page_id", F.lit("Assistant")))
    marks = (tag(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", F.lit("TOXIC")), tag(pages.where("page_id % 7 = 0"), "page_id", F.lit("toxic")))
    return videos, books, {"terms": terms, "examples": marks}


_SHOWN = "kind, item, title, account, subject, words, media, title_format"


@query(f"""with {_ITEMS} select view, {_SHOWN} from (
        select 'youtube' as view, * from ok where raw = 'YouTube'
        union all select 'video term', * from ok where kind = 'video' and raw = 'Instagram' and te
        union all select 'book example', * from ok where kind = 'book' and ex
        union all select 'account words', * from ok where account = 'src3' and words between 300 and 3000
        union all select 'title format', * from ok where title_format = 'question'
        union all select 'unassigned', * from ok where subject is null
        union all select 'subject text', * from ok where subject = 'de' and lower(title) like '%t 9%')""")
def library_items(spark, sf_dir):
    """Documents as videos and pages as books under each filter of the list; orders are tested apart, as rows have none here."""
    videos, books, tags = _items(spark, sf_dir)
    asked = {
        "youtube": {"kind": "youtube"},
        "video term": {"kind": "video", "term": "assistant"},
        "book example": {"kind": "book", "example": "Toxic"},
        "account words": {"account": "src3", "least": 300, "most": 3000},
        "title format": {"title_format": "question", "order": "title"},
        "unassigned": {"subject": "Unassigned"},
        "subject text": {"subject": "de", "text": "T 9", "order": "words"},
    }
    cols = _SHOWN.split(", ")
    none = {c: F.lit(None).cast("string") for c in ("media", "title_format")}

    def view(name: str, filters: dict) -> DataFrame:
        rows = library.library_items(videos, books, ["en", "de"], **tags, **filters)
        return rows.withColumns({c: v for c, v in none.items() if c not in rows.columns}).select(F.lit(name).alias("view"), *cols)

    return reduce(DataFrame.union, [view(name, filters) for name, filters in asked.items()])


_HANDLE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_CLEAN = "lower(regexp_replace(split_part(u, '?', 1), '/+$', ''))"
_ROSTER = f"""h as (select page_id, url, split_part(coalesce(url, ''), '/', 3) host, split_part(coalesce(url, ''), '?', 1) bare from pages),
        s as (select 0 s, page_id id, host n, url u, case when page_id % 2 = 0 then 'p' || page_id end t, 'd' || (page_id % 50) a, page_id % 3 = 0 c from h
            union all select 1, page_id, upper(replace(host, '.', ' ')), bare || '/?again=1', 'q' || page_id, 'd' || (page_id % 70), page_id % 4 = 0 from h where page_id % 3 > 0 and (page_id % 4 = 0 or page_id % 5 > 0)
            union all select 2, page_id, '@' || host, upper(bare), null, null, page_id % 5 = 0 from h where page_id % 5 < 2),
        k as (select *, {_HANDLE.format('n')} "key", sha256({_CLEAN}) link from s),
        v as (select "key", link, arg_min(u, s * 1e12 + id) url, arg_min(t, s * 1e12 + id) filter (t is not null) title, max(a) "at",
            max(id) filter (s = 0) library_id, coalesce(arg_max(c, id) filter (s = 0), null) library_classified, max(id) filter (s = 1) production_id, arg_max(c, id) filter (s = 1) production_classified, max(id) filter (s = 2) format_id, arg_max(c, id) filter (s = 2) format_classified from k where u <> '' group by all)"""


def _sections(spark, sf_dir) -> dict[str, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    p, link = F.col("page_id"), F.coalesce("url", F.lit(""))
    host, bare = F.split_part(link, F.lit("/"), F.lit(3)), F.split_part(link, F.lit("?"), F.lit(1))
    word = lambda letter, n=0: F.concat(F.lit(letter), (p % n if n else p).cast("string"))
    none = F.lit(None).cast("string")
    row = lambda d, name, url, title, at, c: d.select(p.alias("id"), name.alias("name"), url.alias("url"), title.alias("title"), at.alias("at"), c.alias("classified"))
    inputs = pages.where("page_id % 3 > 0").withColumn("status", F.when(p % 4 == 0, "classified").otherwise("pending"))
    shots = pages.select("page_id", (p % 5 > 0).alias("captured"))
    return {
        "library": row(pages, host, F.col("url"), F.when(p % 2 == 0, word("p")), word("d", 50), p % 3 == 0),
        "production": row(rosters.usable_inputs(inputs, shots, "page_id", "status", "captured"), F.upper(F.replace(host, F.lit("."), F.lit(" "))), F.concat(bare, F.lit("/?again=1")), word("q"), word("d", 70), F.col("status") == "classified"),
        "format": row(pages.where("page_id % 5 < 2"), F.concat(F.lit("@"), host), F.upper(bare), none, none, p % 5 == 0),
    }


@query(f"with {_ROSTER} select * replace (coalesce(library_id, -1) as library_id, coalesce(production_id, -1) as production_id, coalesce(format_id, -1) as format_id, coalesce(library_classified::int, -1) as library_classified, coalesce(production_classified::int, -1) as production_classified, coalesce(format_classified::int, -1) as format_classified) from v")
def roster_videos(spark, sf_dir):
    """Pages as videos of three sections that spell accounts and links in their own ways, one row an account and link
    (ids and whether classified: -1 without one)."""
    rows = rosters.roster_videos(_sections(spark, sf_dir))
    names = [f"{s}_{w}" for s in ("library", "production", "format") for w in ("id", "classified")]
    whole = {n: F.coalesce(F.col(n).cast("int") if n.endswith("classified") else F.col(n), F.lit(-1)) for n in names}
    return rows.withColumns(whole)


@query(f"""with {_ROSTER}, cd as (select {_HANDLE.format("n")} "key", min(code) code from (select 'Src' || page_id n, 'PVS.' || page_id code from pages where page_id % 50 = 0 union all select host, 'PVS.' || page_id from h where page_id % 9 = 0) group by all),
        ac as (select "key", arg_min(n, id) filter (s = 0) library_name, arg_min(n, id) filter (s = 1) production_name, arg_min(n, id) filter (s = 2) format_name from k group by all),
        fa as (select arg_min(n, n) n, "key" from (select {_HANDLE.format("n")} "key", n from (select 'Src' || page_id n from pages where page_id % 50 = 0 union all select host from h where page_id % 9 = 0)) group by "key"),
        jo as (select coalesce(ac."key", fa."key") "key", library_name, production_name, coalesce(format_name, fa.n) format_name from ac full join fa on ac."key" = fa."key"),
        nu as (select "key", count(*) videos, count(library_id) library_stored, count(*) filter (library_classified) library_classified, count(production_id) production_stored, count(*) filter (production_classified) production_classified, count(format_id) format_stored, count(*) filter (format_classified) format_classified from v group by all),
        di as (select *, coalesce(nullif(format_name, ''), nullif(library_name, ''), nullif(production_name, ''), "key") d from jo)
        select "key", library_name, null::varchar library_code, production_name, null::varchar production_code, format_name, code format_code, coalesce(videos, 0) videos, coalesce(library_stored, 0) library_stored, coalesce(library_classified, 0) library_classified, coalesce(production_stored, 0) production_stored, coalesce(production_classified, 0) production_classified, coalesce(format_stored, 0) format_stored, coalesce(format_classified, 0) format_classified,
            case when d like '@%' then d else '@' || d end display from di left join cd using ("key") left join nu using ("key")""")
def roster_accounts(spark, sf_dir):
    """The accounts of those sections, with format profiles that have no page yet."""
    sections = _sections(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    code = F.concat(F.lit("PVS."), F.col("page_id").cast("string")).alias("code")
    host = F.split_part(F.coalesce("url", F.lit("")), F.lit("/"), F.lit(3))
    held = pages.where("page_id % 50 = 0").select(F.concat(F.lit("Src"), F.col("page_id").cast("string")).alias("name"), code).union(pages.where("page_id % 9 = 0").select(host, code))
    return rosters.roster_accounts(sections, rosters.roster_videos(sections), ("format", "library", "production"), {"format": held})


_STORIES = """sc as (select c_custkey script, case when c_custkey % 7 > 0 then c_name else '' end title, c_mktsegment account, 'd' || (c_custkey % 100) "at" from customer),
        sp as (select o_orderkey spec, o_custkey script, o_orderpriority title, o_orderstatus account, strftime(o_orderdate, '%Y-%m-%d') "at" from orders),
        vd as (select l_orderkey * 8 + l_linenumber video, max(l_orderkey) + case when l_orderkey * 8 + l_linenumber < 400 then 10000000000 else 0 end spec, null::varchar title, max(strftime(l_shipdate, '%Y-%m-%d')) "at" from lineitem where l_returnflag = 'R' group by l_orderkey * 8 + l_linenumber),
        ns as (select script, max(spec) spec from sp where script is not null group by script), nv as (select spec, max(video) video from vd where spec is not null group by spec),
        st as (select sc.script, ns.spec, nv.video, coalesce(nullif(sc.title, ''), 'Script #' || sc.script) title, account, "at" from sc left join ns on ns.script = sc.script left join nv on nv.spec = ns.spec
            union all select null, sp.spec, nv.video, title, account, "at" from sp left join nv on nv.spec = sp.spec where sp.spec not in (select spec from ns where script in (select script from sc))
            union all select null, null, video, 'Video #' || video, null, "at" from vd where video not in (select video from nv where spec in (select spec from sp))),
        so as (select *, case when video is not null then 'video' when spec is not null then 'shots' else 'script' end stage from st)"""


def _stories(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    scripts = table(spark, sf_dir, "customer").select(c.alias("script"), F.when(c % 7 > 0, F.col("c_name")).otherwise("").alias("title"), F.col("c_mktsegment").alias("account"), F.concat(F.lit("d"), (c % 100).cast("string")).alias("at"))
    specs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec"), F.col("o_custkey").alias("script"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("account"), day("o_orderdate").alias("at"))
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    made = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(number.alias("video")).agg(F.max("l_orderkey").alias("o"), F.max(day("l_shipdate")).alias("at"))
    lost = F.when(F.col("video") < 400, 10_000_000_000).otherwise(0)
    return rosters.stories(scripts, specs, made.select("video", (F.col("o") + lost).alias("spec"), F.lit(None).cast("string").alias("title"), "at"))


@query(f"""with {_STORIES}, co as (select * replace (coalesce(script, -1) as script, coalesce(spec, -1) as spec, coalesce(video, -1) as video) from so)
        select 'all' as view, * from co union all select 'shots', * from co where stage = 'shots' union all select 'text', * from co where lower(title) like '%o #%' or lower(account) like '%o #%' union all select 'video text', * from co where stage = 'video' and (lower(title) like '%er#%' or lower(account) like '%er#%')""")
def story_list(spark, sf_dir):
    """Customers as scripts, orders as their specs, returned lines as videos: the list under its filters (numbers: -1
    without one)."""
    rows = _stories(spark, sf_dir)
    asked = {"all": {}, "shots": {"stage": "shots"}, "text": {"text": "O #"}, "video text": {"stage": "video", "text": "er#"}}
    parts = [rosters.story_list(rows, **f).withColumn("view", F.lit(view)) for view, f in asked.items()]
    return reduce(DataFrame.unionByName, parts).fillna(-1, ["script", "spec", "video"])


@query(f"""with {_STORIES} select count(*) filter (stage = 'script') script, count(*) filter (stage = 'shots') shots, count(*) filter (stage = 'video') video, count(*) "all" from so""")
def stage_counts(spark, sf_dir):
    return rosters.stage_counts(_stories(spark, sf_dir))


@query("""with a as (select doc_id, n_chars::double n_chars, toxic::double toxic, case when doc_id % 40 = 3 then 'src9' else source end source from documents left join labels using (doc_id)),
        v as (select source, x.attribute, x.value from a, lateral (values ('n_chars', n_chars), ('toxic', toxic)) x(attribute, value) where x.value is not null)
        select source, attribute, count(*) n, round(avg(value), 4) mean, min(value) low, max(value) high, round(quantile_cont(value, 0.5), 4) median from v where source is not null group by all""")
def reassigned_profiles(spark, sf_dir):
    """Each fortieth document moves to src9: only the sources that lost or got one are built again."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "n_chars", "toxic")
    moves = docs.where("doc_id % 40 = 3").select("doc_id", F.lit("src9").alias("source"))
    build = lambda d: profiles.numeric_fingerprint(profiles.long_numeric(d.where("source is not null"), ["source"], ["n_chars", "toxic"]), "source").drop("std")
    done = library.reassign_and_rebuild(docs, moves, build(docs), "doc_id", "source", build)
    return done["prints"].withColumns({c: F.round(c, 4) for c in ("mean", "median")})


@query("""with p as (select page_id, case when l like '%instagram.com%' then 'Instagram' when l like '%youtube.com%' or l like '%youtu.be%' then 'YouTube' when l like '%facebook.com%' or l like '%fb.watch%' then 'Facebook' when l like '%tiktok.com%' then 'TikTok' when l like '%.org/%' then 'Web' end r, case page_id % 3 when 0 then 'YouTube' when 1 then 'Web' end m from (select *, lower(coalesce(url, '')) l from pages))
        select page_id, case when m is not null and r is not null then r else m end media from p""")
def corrected_media(spark, sf_dir):
    """Pages whose media type was set by number, after the repair; links of the .org kind count as web pages, others tell nothing."""
    p = F.col("page_id")
    pages = table(spark, sf_dir, "pages").withColumn("media", F.when(p % 3 == 0, "YouTube").when(p % 3 == 1, "Web"))
    known = T.platform(F.col("url"), "")
    right = F.when(known != "", known).when(F.contains(F.lower(F.coalesce("url", F.lit(""))), F.lit(".org/")), "Web")
    return library.corrected_media(pages, "media", right).select("page_id", "media")


@query(_COMPLETE + " select doc_id, source, score, n_attributes from co")
def weighted_scores(spark, sf_dir):
    """Complete scores by a weights table after edits; two are no weights and change nothing."""
    features = _features_once(spark, sf_dir)
    stored = reduce(DataFrame.union, [_shares(spark, sf_dir).select("attribute", F.lit("categorical").alias("kind")).distinct(), _prints(spark, sf_dir, features).select("attribute", F.lit("numeric").alias("kind")).distinct()])
    edits = spark.sql("select * from values (1, 'word_count', '9'), (2, 'word_count', '2.0'), (3, 'word_count', 'x'), (4, 'lang', '0.5'), (5, 'toxic', '-1'), (6, 'quality', null), (7, 'gone', '3') t(edit_id, attribute, weight)")
    weights = scoring.edited_weights(stored.withColumn("weight", F.lit(1.0)), edits)
    items = scoring.item_maps(profiles.long_numeric(features, ["doc_id"], SCORED), profiles.long_categorical(_classed(spark, sf_dir), ["doc_id"], CATEGORICAL), "doc_id")
    maps = scoring.profile_maps(_prints(spark, sf_dir, features), _shares(spark, sf_dir), "source")
    chosen = scoring.comparable(_profile_table(spark, sf_dir)).join(maps, "source", "left")
    return scoring.complete_scores(items, chosen, "doc_id", "source", weights, SHARED).drop("breakdown")


@query(f"select d.*, coalesce(source = 'src' || (item_id % 8), false) is_target from ({base.ORACLE_SQL['rewrite_deltas']}) d")
def rewrite_targets(spark, sf_dir):
    """Scores of the first half of each text (as the original) beside the whole (as the rewrite), made for the source that
    the text's number gives."""
    done = base.rewrite_deltas(spark, sf_dir)
    pre, post = (done.select("item_id", "source", F.col(c).alias("score")) for c in ("before", "after"))
    targets = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 8).cast("string")).alias("source"))
    return views.deltas(pre, post, ["item_id", "source"], targets)


@query("""with d as (select doc_id, source, text, lang, case when quality = 1 then 'Good' when quality = 0 then 'Bad' end form from documents left join labels using (doc_id)),
        c(source, kind, value) as (values ('src0', 'banned_word', 'the'), ('src1', 'banned_word', 'zzz'), ('src2', 'banned_tone', 'de'), ('src3', 'banned_format', 'bad'), ('src4', 'banned_tone', 'none')),
        u as (select source, 'banned_word' kind, lower(w) as value, doc_id from (select source, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+')) w from d) union all select source, 'banned_tone', lower(lang), doc_id from d union all select source, 'banned_format', lower(form), doc_id from d)
        select c.source, c.kind, c.value, count(distinct doc_id) items, count(doc_id) uses from c left join u on u.source = c.source and u.kind = c.kind and u.value = c.value group by all""")
def constraint_uses(spark, sf_dir):
    """Constraints of five sources after edits, and how often their documents break them; the language is the tone."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    docs = docs.withColumn("form", F.when(F.col("quality") == 1, "Good").when(F.col("quality") == 0, "Bad"))
    stored = spark.sql("select * from values ('src0', 'banned_word', 'The'), ('src1', 'banned_word', 'gone'), ('src2', 'banned_tone', 'DE') t(source, kind, value)")
    edits = spark.sql("select * from values (1, 'src1', 'banned_word', 'gone', 'remove'), (2, 'src1', 'banned_word', ' zzz', 'add'), (3, 'src3', 'banned_format', 'Bad', 'add'), (4, 'src4', 'banned_tone', 'none', 'add'), (5, 'src4', 'banned_smell', 'x', 'add'), (6, 'src4', 'banned_word', ' ', 'add') t(edit_id, source, kind, value, action)")
    return cards.constraint_uses(docs, cards.constraints_after(stored, edits, "source"), "source", "doc_id", "text", "lang", "form")


@query("""with c as (select l_orderkey * 8 + l_linenumber creation, max(l_linestatus) status, max(l_suppkey) supplier, max(l_partkey) part, max(l_orderkey) o, max(strftime(l_shipdate, '%Y-%m-%d')) made from lineitem where l_linenumber = 1 group by all)
        select creation, 'Clip ' || creation title, status, 'PS.' || (supplier % 5) profile, case when part % 2 = 0 then part else -1 end input, case when part % 2 = 0 then (select p_type from part where p_partkey = c.part) end input_title, case when part % 2 = 1 then o else -1 end spec, case when part % 2 = 1 then (select o_orderpriority from orders where o_orderkey = c.o) end spec_title, made from c where status = 'O' and supplier % 5 = 1""")
def production_creations(spark, sf_dir):
    """First lines of orders as creations, half from a part (an input), half from the order (a spec), of a status and profile."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    one = lines.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("creation")).agg(F.max("l_linestatus").alias("status"), F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"), F.max("l_orderkey").alias("o"), F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("made"))
    made = one.select("creation", F.concat(F.lit("Clip "), F.col("creation").cast("string")).alias("title"), "status", F.concat(F.lit("PS."), (F.col("s") % 5).cast("string")).alias("profile"), F.when(F.col("p") % 2 == 0, F.col("p")).alias("input"), F.when(F.col("p") % 2 == 1, F.col("o")).alias("spec"), "made")
    inputs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("input"), F.col("p_type").alias("title"))
    specs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec"), F.col("o_orderpriority").alias("title"))
    return rosters.production_creations(made, inputs, specs, status="O", profile="PS.1").fillna(-1, ["input", "spec"])


@query("with p as (select source, case when count(*) >= 10 then 'confirmed' else 'draft' end status from documents group by source) select status, count(*) n, round(round(100.0 * count(*) / sum(count(*)) over (), 9), 1) percent from p group by status")
def profiles_by_status(spark, sf_dir):
    return catalog.by_share(_profile_table(spark, sf_dir), "status")


@query("select 'text' medium, 1::bigint fields, round(100.0 * count(lang) / count(*), 6) mean_percent, count(*) items from documents union all select 'page', 1, round(100.0 * count(url) / count(*), 6), count(*) from pages")
def media_item_cards(spark, sf_dir):
    """Cards of documents and pages with the number of their items."""
    items = {"text": table(spark, sf_dir, "documents"), "page": table(spark, sf_dir, "pages")}
    return rounded(catalog.media_cards({m: profiles.coverage(d, [c]) for (m, d), c in zip(items.items(), ("lang", "url"), strict=True)}, items))
