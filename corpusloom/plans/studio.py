"""Queries of whole scores, profiles, matching and upkeep, with SQL that gives the same rows in DuckDB.

The given tables stand for the library's: documents for scripts, sources for accounts, lines of orders for shots. Where a
table lacks a column, the query derives it from another and says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import matching, members, profiles, ranking, scoring, topk, upkeep, views
from corpusloom.operators import pages as page_finder
from corpusloom.plans.queries import QUERIES as QUERIES_OF_PLANS
from corpusloom.plans.queries import _LONG, _NORMAL, _PRINTS, _SCORES, SCORED, _cosine_words, _even, _feature_ctes, _features_once, _prints, _scores, rounded, table
from corpusloom.sources import staging

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WEIGHTS = {"word_count": 2.0, "lang": 0.5}
SHARED = ["avg_sentence_len", "lexical_diversity", "lang"]
MACROS = {"form": ["word_count", "avg_sentence_len", "sentence_len_variance"], "voice": ["filler_count", "punctuation_density", "lexical_diversity"], "class": ["lang", "quality", "toxic"]}
CATEGORICAL = ["lang", "quality", "toxic"]


def _classed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _shares(spark, sf_dir) -> DataFrame:
    return profiles.categorical_fingerprint(profiles.long_categorical(_classed(spark, sf_dir), ["source"], CATEGORICAL), "source")


def _profile_table(spark, sf_dir) -> DataFrame:
    """Sources as profiles: confirmed from ten texts on; src1 and src3 are books, src5 are production specs."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    media = F.when(F.col("source").isin("src1", "src3"), "Book").when(F.col("source") == "src5", "ProductionSpec").otherwise("Video")
    return docs.select("source", "n", media.alias("media"), F.when(F.col("n") >= 10, "confirmed").otherwise("draft").alias("status"))


def _complete(spark, sf_dir) -> DataFrame:
    features = _features_once(spark, sf_dir)
    items = scoring.item_maps(profiles.long_numeric(features, ["doc_id"], SCORED), profiles.long_categorical(_classed(spark, sf_dir), ["doc_id"], CATEGORICAL), "doc_id")
    maps = scoring.profile_maps(_prints(spark, sf_dir, features), _shares(spark, sf_dir), "source")
    chosen = scoring.comparable(_profile_table(spark, sf_dir)).join(maps, "source", "left")
    return scoring.complete_scores(items, chosen, "doc_id", "source", WEIGHTS, SHARED)


_SUB = """round(case when high - low <= 1e-9 then greatest(0.0, 100 - 40 * abs(value - median) / greatest(0.15 * abs(median), 0.5))
            when value between low and high then greatest(60.0, 100 - 40 * abs(value - median) / ((high - low) / 2))
            else greatest(0.0, 60 - 40 * (case when value < low then low - value else value - high end) / (high - low)) end, 1)"""
_SHARE_CTES = f"""sd as (select doc_id, source, lang, quality::varchar quality, toxic::varchar toxic from documents left join labels using (doc_id)),
        sv as (select doc_id, source, x.attribute, x.value from sd, lateral (values ('lang', lang), ('quality', quality), ('toxic', toxic)) x(attribute, value) where x.value is not null),
        sc as (select source, attribute, value, count(*) n from sv group by all),
        sh as (select *, {_even('100.0 * n / sum(n) over (partition by source, attribute)', 1)} share from sc)"""
_COMPLETE = _feature_ctes("documents") + _PRINTS + f""", {_SHARE_CTES},
        pt0 as (select source, count(*) n, case when source in ('src1', 'src3') then 'Book' when source = 'src5' then 'ProductionSpec' else 'Video' end media from documents group by all),
        pt1 as (select *, case when n >= 10 then 'confirmed' else 'draft' end status from pt0 where media <> 'ProductionSpec'),
        pt as (select * from pt1 where status = 'confirmed' or not exists (select 1 from pt1 where status = 'confirmed')),
        it as (select doc_id, v.attribute, v.value from f, lateral (values {_LONG}) v(attribute, value) where v.value is not null),
        su as (select doc_id, source, attribute, {_SUB} subscore from it join pr using (attribute)
            union all select sv.doc_id, a.source, sv.attribute, round(20 + 0.8 * coalesce(sh.share, 0.0), 1) from sv join (select distinct source, attribute from sh) a using (attribute) left join sh on sh.source = a.source and sh.attribute = a.attribute and sh.value = sv.value),
        ws as (select su.*, media, case attribute when 'word_count' then 2.0 when 'lang' then 0.5 else 1.0 end::double w from su join pt using (source) where subscore is not null and (media <> 'Book' or attribute in ('avg_sentence_len', 'lexical_diversity', 'lang'))),
        al as (select doc_id, source, media from documents d, pt where true),
        cs as (select d.doc_id, pt.source, pt.media, round(round(sum(subscore * w) / sum(w), 6), 1) m, count(subscore) n_attributes from (select doc_id from documents) d cross join pt left join ws on ws.doc_id = d.doc_id and ws.source = pt.source group by all),
        co as (select doc_id, source, case when media = 'Book' then m else coalesce(m, 0.0) end score, n_attributes from cs)""".replace("\n        al as (select doc_id, source, media from documents d, pt where true),", "")


@query(_COMPLETE + " select *, row_number() over (partition by doc_id order by score desc nulls last, source)::int place from co")
def complete_scores(spark, sf_dir):
    """Every document against every comparable profile, over numeric and categorical attributes, ranked."""
    return profiles.rank(_complete(spark, sf_dir).drop("breakdown"), "doc_id", "source")


@query(_COMPLETE + ", g as (select *, case when attribute in ('word_count', 'avg_sentence_len', 'sentence_len_variance') then 'form' when attribute in ('filler_count', 'punctuation_density', 'lexical_diversity') then 'voice' when attribute in ('lang', 'quality', 'toxic') then 'class' else 'Other' end macro from ws) select doc_id, source, macro, " + _even("round(avg(subscore), 6)", 1) + " fit, count(*) fields from g group by all")
def macro_fit(spark, sf_dir):
    return rounded(scoring.macro_fit(_complete(spark, sf_dir), "doc_id", "source", MACROS))


@query(_COMPLETE + """, ma(macro, field) as (values ('form', 'word_count'), ('form', 'avg_sentence_len'), ('form', 'sentence_len_variance'), ('voice', 'filler_count'), ('voice', 'punctuation_density'), ('voice', 'lexical_diversity'), ('class', 'lang'), ('class', 'quality'), ('class', 'toxic'))
        select co.doc_id, co.source, ma.macro, round(100.0 * 3 / 9, 6) share, count(ws.attribute) scored, 3::bigint total from co cross join ma left join ws on ws.doc_id = co.doc_id and ws.source = co.source and ws.attribute = ma.field group by all""")
def shared_valuation(spark, sf_dir):
    return scoring.shared_valuation(_complete(spark, sf_dir), "doc_id", "source", MACROS)


@query(_COMPLETE + ", la as (select doc_id from documents order by n_chars desc, doc_id desc limit 200) select doc_id, source, score, n_attributes from co where doc_id in (select doc_id from la) qualify row_number() over (partition by doc_id order by score desc nulls last, source) = 1")
def best_profiles_of_latest(spark, sf_dir):
    """The best profile of the 200 longest documents, as if length were their age."""
    tests = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return scoring.best_of_latest(_complete(spark, sf_dir), tests, "doc_id", "source", "n_chars", 200).select("doc_id", "source", "score", "n_attributes")


@query(_SCORES + " select *, row_number() over (partition by item_id order by score desc, source)::int place, case when source in ('src0', 'src2') then 'short' when source = 'src4' then 'long' else 'other' end band from sc")
def score_bands(spark, sf_dir):
    ranked = profiles.rank(rounded(_scores(spark, sf_dir)), "item_id", "source")
    bands = spark.sql("select * from values ('src0', 'A'), ('src2', 'A'), ('src4', 'C') t(source, length_band)")
    return scoring.in_bands(ranked, bands, "source")


_LIKE = _feature_ctes("documents") + _PRINTS + f""", {_SHARE_CTES},
        nu as (select a.source a, b.source b, attribute, 'numeric' kind, round(100 * (1 - least(abs(a.mean - b.mean) / greatest(abs(a.mean), abs(b.mean), 1e-6), 1.0)), 1) percent from pr a join pr b using (attribute) where a.source < b.source),
        ca as (select a.source a, b.source b, attribute, 'categorical' kind, round(sum(least(a.share, coalesce(c.share, 0))), 1) percent from sh a join (select distinct source, attribute from sh) b using (attribute) left join sh c on c.source = b.source and c.attribute = a.attribute and c.value = a.value where a.source < b.source group by all),
        li as (select * from nu union all select * from ca)"""


@query(_LIKE + " select * from li")
def profile_likeness(spark, sf_dir):
    return profiles.similarity_rows(_prints(spark, sf_dir, _features_once(spark, sf_dir)), _shares(spark, sf_dir), "source")


@query(_LIKE + " select a, b, round(round(avg(percent), 6), 1) percent, count(*) n_attributes from li group by all")
def overall_similarity(spark, sf_dir):
    return profiles.overall_similarity(profiles.similarity_rows(_prints(spark, sf_dir, _features_once(spark, sf_dir)), _shares(spark, sf_dir), "source"))


@query("""with i as (select source, lang, array_to_string(string_split_regex(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+')[1:2], ' ') title from documents join labels using (doc_id) where quality = 1),
        k as (select source, lang, count(*) c from i where lang is not null group by all), m as (select source, lang from k qualify row_number() over (partition by source order by c desc, lang) = 1),
        r as (select source, count(*) n, array_to_string(list_sort(list_distinct(list(title))), '; ') overview from i group by all)
        select source, n, overview, lang, case when n >= 10 then 'confirmed' else 'draft' end status from r left join m using (source)""")
def profile_rows(spark, sf_dir):
    """Sources by their documents of quality 1 as analysed items, the language as medium, two words as title."""
    docs = _classed(spark, sf_dir).where("quality = 1")
    title = F.array_join(F.slice(F.split(T.stripped(F.col("text")), r"\s+"), 1, 2), " ")
    return profiles.profile_rows(docs.withColumn("title", title), "source", 10, "lang", "title")


@query(f"""with {_SHARE_CTES}, w(source, weight) as (values ('src0', 0.75), ('src1', 0.25)), r as (select * from sh join w using (source)),
        t as (select attribute, sum(weight) wt from (select distinct attribute, source, weight from r) group by all)
        select 'mix' as hybrid, attribute, value, round(sum(share * weight) / any_value(wt), 3) share from r join t using (attribute) group by attribute, value""")
def hybrid_shares(spark, sf_dir):
    """Shares of a blend of src0 and src1, the fixed weights of a user's choice."""
    weights = spark.sql("select * from values ('src0', 'mix', 0.75D), ('src1', 'mix', 0.25D) t(source, hybrid, weight)")
    return profiles.hybrid_shares(_shares(spark, sf_dir), weights, "source", "hybrid")


@query(f"""with {_SHARE_CTES}, v as (select source, attribute, value::double as value from sv where attribute in ('quality', 'toxic'))
        select source, attribute, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, min(value) low, max(value) high, round(quantile_cont(value, 0.5), 6) median from v group by all""")
def boolean_fingerprint(spark, sf_dir):
    rows = profiles.long_categorical(_classed(spark, sf_dir), ["source"], ["quality", "toxic"])
    return rounded(profiles.boolean_fingerprint(rows, "source"))


_SUBJECT = "case " + " ".join(f"when contains(d, '{s.lower()}') then '{s}'" for s in matching.SUBJECTS) + " " + " ".join(f"when regexp_matches(d, '{'|'.join(h)}') then '{s}'" for s, h in matching.SUBJECT_HINTS.items()) + " end"


@query(f"""with i as (select p_brand, {_SUBJECT} s from (select p_brand, lower(trim(coalesce(p_type, ''))) d from part)), v as (select p_brand, s, count(*) n from i group by all)
        select p_brand, s subject, case when s is null then 0 else n end votes from v qualify row_number() over (partition by p_brand order by s is null, n desc, s) = 1""")
def account_subjects(spark, sf_dir):
    """Brands as accounts, types of parts as domains."""
    return matching.account_subjects(table(spark, sf_dir, "part"), "p_brand", "p_type")


_STOP = ", ".join(f"'{w}'" for w in matching.STOPWORDS)
_BEST_WORDS = lambda source, key: f"select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+')) word from {source}"


@query(f"""with a as ({_BEST_WORDS("benchmark", "item_id")}), b as ({_BEST_WORDS("documents", "source")}),
        x as (select item_id, word, count(*) x from a where length(word) > 2 and word not in ({_STOP}) group by all), y as (select source, word, count(*) y from b where length(word) > 2 and word not in ({_STOP}) group by all),
        nx as (select item_id, sqrt(sum(x * x)) nx from x group by all), ny as (select source, sqrt(sum(y * y)) ny from y group by all),
        c as (select item_id, source, round(sum(x * y) / (any_value(nx) * any_value(ny)), 9) cosine from x join y using (word) join nx using (item_id) join ny using (source) group by item_id, source)
        select item_id, source, round_even(100 * cosine, 0)::bigint confidence from c qualify row_number() over (partition by item_id order by cosine desc, source) = 1""")
def best_account(spark, sf_dir):
    def words(name: str, key: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z']+"), F.lit(0))).alias("word"))
        return rows.where(F.length("word") > 2).where(~F.col("word").isin(*matching.STOPWORDS))

    return matching.best_account(words("benchmark", "item_id"), words("documents", "source"), "item_id", "source")


@query(f"""with a as (select distinct * from ({_cosine_words("benchmark", "item_id")})), b as (select distinct * from ({_cosine_words("documents", "source")})), n as (select item_id, count(*) n from a group by all),
        m as (select item_id, source, count(*) shared, round(count(*) / any_value(n), 6) overlap from a join b using (word) join n using (item_id) where source is not null group by item_id, source)
        select *, row_number() over (partition by item_id order by shared desc, source)::int place from m qualify place <= 3""")
def topical_best(spark, sf_dir):
    """Benchmark passages as candidates, sources as accounts: the three whose words hold most of a passage's."""
    texts = matching.word_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, [])
    own = matching.word_rows(table(spark, sf_dir, "documents").where("source is not null"), "source", "text", 3, [])
    return rounded(topk.best_overlaps(texts, own, "item_id", "source"))


_NUM, _CAP = (p.replace("'", "''") for p in (matching.NUMBERS, matching.NAMES))


@query(f"""with e as (select item_id, 'src' || (item_id % 20) book, text from benchmark),
        k as (select book, item_id, unnest(list_concat(list_transform(list_filter(list_transform(regexp_extract_all(text, '{_NUM}'), lambda t: trim(t)), lambda t: length(t) > 1), lambda t: {{'t': t, 'w': 3}}),
            list_transform(list_filter(regexp_extract_all(text, '{_CAP}'), lambda t: not list_contains({matching.OPENINGS}, string_split_regex(t, '\\s')[1])), lambda t: {{'t': t, 'w': case when contains(t, ' ') then 2 else 1 end}}))) x from e),
        g as (select book, item_id, doc_id, sum(case when contains(d.text, x.t) then x.w else 0 end)::bigint score from k join documents d on d.source = book group by all)
        select book, item_id, doc_id, score from g where score >= 2 qualify row_number() over (partition by book, item_id order by score desc, doc_id desc) = 1""")
def page_match(spark, sf_dir):
    """Benchmark passages as examples, documents as pages of the book that their source is; each item belongs to one source by its number."""
    examples = table(spark, sf_dir, "benchmark").withColumn("book", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    pages = table(spark, sf_dir, "documents").withColumnRenamed("source", "book")
    return page_finder.page_match(examples, pages, "book", "item_id", F.col("text"), "doc_id", "text", 2)


@query("""with a as (select s_suppkey, s_name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') n, case when s_suppkey % 3 = 0 then -1 end customer from supplier),
        c as (select regexp_replace(lower('SUPPLIER-' || substr(c_name, 10)), '[^a-z0-9]', '', 'g') n, min(c_custkey) k from customer group by all),
        p as (select regexp_replace(lower('supplier ' || substr(c_name, 10)), '[^a-z0-9]', '', 'g') n, min(c_nationkey)::bigint k from customer group by all)
        select s_suppkey, s_name, coalesce(customer::bigint, c.k) customer, p.k nation from a left join c using (n) left join p using (n)""")
def linked_kinds(spark, sf_dir):
    """Suppliers as accounts; customers' numbers under two spellings of the name as profiles of two kinds."""
    accounts = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, -1).cast("long").alias("customer"), F.lit(None).cast("long").alias("nation"))
    customers = table(spark, sf_dir, "customer").withColumn("number", F.substring("c_name", 10, 99))
    kinds = {"customer": customers.select(F.concat(F.lit("SUPPLIER-"), "number").alias("s_name"), F.col("c_custkey").alias("key")), "nation": customers.select(F.concat(F.lit("supplier "), "number").alias("s_name"), F.col("c_nationkey").cast("long").alias("key"))}
    return matching.linked_kinds(accounts, kinds, "s_name", "key")


@query("""with a as (select case when o_orderstatus <> 'P' then 'h' || o_orderkey end h, o_orderkey k, o_totalprice v from orders),
        b as (select case when l_orderkey % 4 > 0 then 'h' || l_orderkey end h, l_orderkey k, sum(l_extendedprice) v from lineitem group by all),
        x as (select coalesce(h, 'a:' || k) as key, v from a), y as (select coalesce(h, 'b:' || k) as key, v from b)
        select coalesce(x.key, y.key) as key, round(coalesce(x.v, y.v), 6) price, x.key is not null in_first, y.key is not null in_second from x full join y on x.key = y.key""")
def two_readings(spark, sf_dir):
    """Orders and the sums of their lines as two readings; some of either have no hash."""
    first = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("h"), F.col("o_orderkey").cast("string"))).alias("h"), F.col("o_orderkey").alias("k"), "o_totalprice")
    second = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("total"))
    second = second.withColumn("h", F.when(F.col("k") % 4 > 0, F.concat(F.lit("h"), F.col("k").cast("string"))))
    return rounded(matching.two_readings(first, second, "h", "k", {"price": ("o_totalprice", "total")}))


@query(_SCORES + f""", a as (select distinct * from ({_cosine_words("benchmark", "item_id")})), b as (select distinct * from ({_cosine_words("documents", "source")})), n as (select item_id, count(*) n from a group by all),
        tp as (select item_id, source, round(count(*) / any_value(n), 6) topical from a join b using (word) join n using (item_id) group by item_id, source),
        mt as (select item_id, source, round_even(100 * (0.6 * case when item_id % 7 = substr(source, 4)::int % 7 then 1.0 else 0.0 end::double + 0.2 * (score / 100)::double + 0.2 * coalesce(topical, 0.0)::double), 0)::bigint as match, source = 'src' || (item_id % 20) own from sc left join tp using (item_id, source)),
        fi as (select *, row_number() over (partition by item_id order by match desc, source) r from mt), ke as (select * from fi where not own or r = 1)
        select item_id, source, match, row_number() over (partition by item_id order by match desc, source)::int place from ke qualify place <= 3""")
def blended_match(spark, sf_dir):
    """Benchmark passages as candidates; a subject fits where the numbers of item and source agree by seven."""
    voice = staging.staged(rounded(_scores(spark, sf_dir)), "voice").select("item_id", "source", (F.col("score") / 100).alias("voice"))
    topical = QUERIES_OF_PLANS["topical_overlap"](spark, sf_dir).select("item_id", "source", F.col("overlap").alias("topical"))
    number = F.substring("source", 4, 9).cast("int")
    subject = voice.select("item_id", "source", F.when(F.col("item_id") % 7 == number % 7, 1.0).otherwise(0.0).alias("subject"))
    own = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    return matching.blended_match(subject, voice, topical, "item_id", "source", own)


@query()
def corpus_members(spark, sf_dir):
    """Which source's corpus holds another document with the same whole text, or nearly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return members.membership(docs, None, "doc_id", "text", "source", "owned")


@query()
def member_scores(spark, sf_dir):
    """Every document against every comparable profile; the corpus of a profile that holds the document decides its score."""
    return scoring.with_members(_complete(spark, sf_dir), QUERIES["corpus_members"](spark, sf_dir), "doc_id", "source").select("doc_id", "source", "score", "match", "similarity", "matched", "n_attributes")


@query(_COMPLETE + """, hx as (select doc_id, source, n from (select doc_id, source, """ + _NORMAL + """ n from documents) where n <> '' and source is not null),
        cm as (select distinct x.doc_id, y.source from hx x join hx y on x.n = y.n and x.doc_id <> y.doc_id)
        select co.doc_id, co.source, case when cm.doc_id is not null then 100.0 else score end score, case when cm.doc_id is not null then 'exact' end "match", n_attributes from co left join cm on cm.doc_id = co.doc_id and cm.source = co.source""")
def copy_scores(spark, sf_dir):
    """Scores where only equal texts count as members."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    copies = members.membership(docs, docs.withColumnRenamed("doc_id", "owned"), "doc_id", "text", "source", "owned", near=None)
    return scoring.with_members(_complete(spark, sf_dir), copies, "doc_id", "source").select("doc_id", "source", "score", "match", "n_attributes")


@query()
def account_suggestions(spark, sf_dir):
    """Suppliers' names as queries against all customers' names; segment and number of orders of those that are told."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_items"))
    accounts = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select(F.col("c_name").alias("account"), F.col("c_custkey").alias("profile"), F.col("c_mktsegment").alias("subject"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
    return matching.suggestions(names, accounts, "name", "account", told=["profile", "subject", "n_items"])


@query(_feature_ctes("documents") + _PRINTS + f""", {_SHARE_CTES},
        nb as (select attribute, source, mean from (select attribute, source, round(mean, 6) mean from pr) qualify row_number() over (partition by attribute order by mean desc, source) = 1),
        cb as (select attribute, source, value from sh qualify row_number() over (partition by attribute order by share desc, source, value) = 1),
        il as (select doc_id, source, v.attribute, v.value from f, lateral (values {_LONG}) v(attribute, value) where v.value is not null),
        ex as (select il.attribute, doc_id, -il.value k from il join nb using (attribute, source) union all select sv.attribute, doc_id, 0.0 from sv join cb using (attribute, source, value)),
        er as (select *, row_number() over (partition by attribute order by k, doc_id) r from ex), ea as (select attribute, string_agg(doc_id::varchar, ',' order by r) examples from er where r <= 2 group by all)
        select attribute, source, 'numeric' kind, round(mean, 3)::varchar told, examples from nb left join ea using (attribute) union all select attribute, source, 'categorical', value, examples from cb left join ea using (attribute)""")
def characteristic_examples(spark, sf_dir):
    """The most characteristic source of each attribute, with two of its documents."""
    features = _features_once(spark, sf_dir)
    numbers = profiles.long_numeric(features, ["source", "doc_id"], SCORED)
    values = profiles.long_categorical(_classed(spark, sf_dir), ["source", "doc_id"], CATEGORICAL)
    return views.characteristic(rounded(_prints(spark, sf_dir, features)), _shares(spark, sf_dir), numbers, values, "source", "doc_id")


_CHAIN = """(select distinct s_suppkey a, case when s_suppkey % 50 = 1 then null when s_suppkey % 90 = 12 then s_suppkey + 1 else s_suppkey - 1 end b from supplier)"""


@query(f"""with recursive m as (select a, min(b) b from {_CHAIN} where b is not null and a <> b group by a),
        w as (select a, b, [a] seen, false cycle from m
            union all select w.a, m.b, list_append(w.seen, m.a), list_contains(w.seen, m.b) from w join m on w.b = m.a where not w.cycle and not list_contains(w.seen, w.b)),
        e as (select a, b from w where b not in (select a from m))
        select m.a s_suppkey, coalesce(e.b, -1) "into", case when e.b is null then 'cycle' else 'merged' end status from m left join e using (a)""")
def account_chains(spark, sf_dir):
    """Suppliers merged into the one before, in chains of fifty; some point at each other and have no end (-1)."""
    key = F.col("s_suppkey")
    into = F.when(key % 50 == 1, None).when(key % 90 == 12, key + 1).otherwise(key - 1)
    ends = upkeep.settled_merges(table(spark, sf_dir, "supplier").select("s_suppkey", into.alias("into")), "s_suppkey")
    return ends.withColumn("into", F.coalesce("into", F.lit(-1)))


@query(_COMPLETE + """, hx as (select doc_id, source, """ + _NORMAL + """ n from documents where source is not null),
        cm as (select x.doc_id, y.source, min(y.doc_id) matched from hx x join hx y on x.n = y.n and x.n <> '' and x.doc_id <> y.doc_id group by all),
        ov as (select co.doc_id, co.source, case when cm.doc_id is not null then 100.0 else score end score, cm.doc_id is not null is_member, matched from co left join cm on cm.doc_id = co.doc_id and cm.source = co.source),
        rk as (select *, row_number() over (partition by doc_id order by score desc nulls last, source)::int place from ov)
        select 'run-1' run_id, doc_id, source, score, place, is_member, coalesce(matched, -1) matched, first_value(source) over (partition by doc_id order by place) best_fit from rk""")
def rating_run(spark, sf_dir):
    """A stored run: every document rated against every comparable profile, equal texts as members (matched: -1 without one), committed twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    copies = members.membership(docs, docs.withColumnRenamed("doc_id", "owned"), "doc_id", "text", "source", "owned", near=None)
    rated = scoring.rated(_complete(spark, sf_dir), copies, "doc_id", "source")
    store = staging.RunStore(spark, f"{staging.shared_folder(spark)}/ratings-{uuid.uuid4().hex}")
    for _ in range(2):  # delivered again, it changes nothing
        store.commit("run-1", {"inputs": docs, "scores": rated.drop("breakdown")})
    best = F.first("source").over(W.partitionBy("run_id", "doc_id").orderBy("place"))
    return store.read("scores").select("run_id", "doc_id", "source", "score", "place", "is_member", F.coalesce("matched", F.lit(-1)).alias("matched"), best.alias("best_fit"))


@query("select l_returnflag, l_linestatus, count(l_extendedprice) n, round(quantile_cont(l_extendedprice::double, 0.5), 6) median from lineitem group by all")
def hot_medians(spark, sf_dir):
    """Exact medians of prices by flag and status: a few keys that hold all lines."""
    return rounded(ranking.medians(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))
