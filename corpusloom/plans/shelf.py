"""Queries of books, listings and creations, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from corpusloom.operators import books, profiles, scoring
from corpusloom.plans.queries import _even, rounded, table
from corpusloom.plans.studio import _COMPLETE, _SUB, MACROS, WEIGHTS, _complete, _profile_table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("select doc_id, source, lang, n_chars from documents where source is not null and doc_id in (select min(doc_id) from documents where source is not null group by source, lang, n_chars // 100)")
def first_editions(spark, sf_dir):
    """Documents as books: the source is the author, language and length in hundreds the title."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.concat_ws("-", F.coalesce("lang", F.lit("")), F.floor(F.col("n_chars") / 100).cast("string")))
    return books.first_editions(docs, "source", "title", "doc_id").select("doc_id", "source", "lang", "n_chars")


@query(f"""with d as (select doc_id, source, lang, quality::double quality, toxic::double toxic from documents left join labels using (doc_id)),
        il as (select doc_id, source, x.attribute, x.value from d, lateral (values ('quality', quality), ('toxic', toxic)) x(attribute, value) where x.value is not null),
        pr as (select source, attribute, min(value) low, max(value) high, quantile_cont(value, 0.5) median from il where source is not null group by all),
        co as (select source, lang, count(*) n from d where lang is not null and source is not null group by all), sh as (select *, {_even("100.0 * n / sum(n) over (partition by source)", 1)} share from co),
        b0 as (select source, case when count(*) >= 10 then 'confirmed' else 'draft' end status from documents where source in ('src1', 'src3') group by source),
        b as (select source from b0 where status = 'confirmed' or not exists (select 1 from b0 where status = 'confirmed')),
        su as (select il.doc_id, b.source, il.attribute, {_SUB} subscore from il join pr using (attribute) join b on b.source = pr.source
            union all select d.doc_id, a.source, 'lang', round(20 + 0.8 * coalesce(sh.share, 0.0), 1) from d join (select distinct source from sh) a on d.lang is not null join b on b.source = a.source left join sh on sh.source = a.source and sh.lang = d.lang),
        sc as (select d.doc_id, b.source, coalesce(round(round(sum(subscore) / count(subscore), 6), 1), 0.0) score, count(subscore) n_attributes from d cross join b left join su on su.doc_id = d.doc_id and su.source = b.source group by all)
        select *, row_number() over (partition by doc_id order by score desc nulls last, source)::int place from sc""")
def book_scores(spark, sf_dir):
    """Documents against the two sources that are books: two yes/no attributes and the language."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    items = scoring.item_maps(profiles.long_numeric(docs, ["doc_id"], ["quality", "toxic"]), profiles.long_categorical(docs, ["doc_id"], ["lang"]), "doc_id")
    items = docs.select("doc_id").distinct().join(items, "doc_id", "left")
    shelf = docs.where("source is not null")
    prints = profiles.boolean_fingerprint(profiles.long_categorical(shelf, ["source"], ["quality", "toxic"]), "source")
    shares = profiles.categorical_fingerprint(profiles.long_categorical(shelf, ["source"], ["lang"]), "source")
    chosen = _profile_table(spark, sf_dir).join(scoring.profile_maps(prints, shares, "source"), "source", "left")
    return books.book_scores(items, chosen, "doc_id", "source").drop("breakdown")


_BOOKS = """b as (select doc_id book, 'Book ' || (doc_id % 97) title, source author, lang subject, (1900 + doc_id % 120)::int as year, n_chars words, doc_id added, case doc_id % 3 when 0 then 1 when 1 then 0 end read,
            case doc_id % 4 when 0 then 'needs_review' when 1 then 'model' when 2 then 'pending' end classified_by from documents)"""


def _books(spark, sf_dir):
    n = F.col("doc_id")
    by = F.when(n % 4 == 0, "needs_review").when(n % 4 == 1, "model").when(n % 4 == 2, "pending")
    return table(spark, sf_dir, "documents").select(n.alias("book"), F.concat(F.lit("Book "), (n % 97).cast("string")).alias("title"), F.col("source").alias("author"), F.col("lang").alias("subject"), (1900 + n % 120).cast("int").alias("year"), F.col("n_chars").alias("words"), n.alias("added"), F.when(n % 3 == 0, 1).when(n % 3 == 1, 0).alias("read"), by.alias("classified_by"))


@query(f"""with {_BOOKS} select view, book, title, author from (
        select 'classified' as view, * from b where classified_by not in ('needs_review', 'pending')
        union all select 'pending', * from b where classified_by is null or classified_by = 'pending'
        union all select 'review unread', * from b where classified_by = 'needs_review' and (read is null or read = 0)
        union all select 'read en', * from b where read = 1 and subject = 'en'
        union all select 'unassigned', * from b where subject is null or subject not in ('en', 'de')
        union all select 'text', * from b where lower(title) like '%k 9%' or lower(coalesce(author, '')) like '%k 9%')""")
def book_list(spark, sf_dir):
    """The list of books under each of its filters; orders are tested apart, as rows have none here."""
    rows = _books(spark, sf_dir)
    asked = {"classified": {"status": "classified"}, "pending": {"status": "pending", "order": "title"}, "review unread": {"status": "needs_review", "read": "unread", "order": "year"}, "read en": {"read": "read", "subject": "en", "order": "author"}, "unassigned": {"subject": "Unassigned", "order": "words"}, "text": {"text": "K 9", "order": "subject"}}
    parts = [books.book_list(rows, ["en", "de"], **f).select(F.lit(view).alias("view"), "book", "title", "author") for view, f in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(_COMPLETE + """, cr as (select doc_id, 'src' || (doc_id % 20) source, case when doc_id % 3 = 0 then 'model' else 'person' end made_by from documents),
        jo as (select cr.doc_id, cr.source, made_by, score, 50.0 before, score - 50.0 gain from cr left join co on co.doc_id = cr.doc_id and co.source = cr.source)
        select doc_id, source, made_by, score, round(gain, 6) gain from jo where made_by = 'model' and gain >= 10""")
def creation_list(spark, sf_dir):
    """Documents as creations for the source that their number gives; each original scored 50. A model's, with a gain of 10."""
    n = F.col("doc_id")
    made = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src"), (n % 20).cast("string")).alias("source"), F.lit("t").alias("title"), F.lit("l").alias("label"), F.when(n % 3 == 0, "model").otherwise("person").alias("made_by"), n.alias("made_at"))
    scores = _complete(spark, sf_dir).select("doc_id", "source", "score", F.lit(50.0).alias("before"))
    return rounded(books.creation_list(made, scores, "doc_id", "source", made_by="model", least=10.0, order="gain").select("doc_id", "source", "made_by", "score", "gain"))


@query(_COMPLETE + """, tg as (select doc_id, source from co where source = 'src' || (doc_id % 20)), v as (select tg.doc_id, attribute, case when attribute in ('word_count', 'avg_sentence_len', 'sentence_len_variance') then 'form' when attribute in ('filler_count', 'punctuation_density', 'lexical_diversity') then 'voice' when attribute in ('lang', 'quality', 'toxic') then 'class' else 'Other' end macro, case attribute when 'word_count' then 2.0 when 'lang' then 0.5 else 1.0 end::double w from tg join ws on ws.doc_id = tg.doc_id and ws.source = tg.source),
        g as (select macro, sum(w) weight, 100.0 * sum(w) / sum(sum(w)) over () share from v group by macro), o as (select *, sum(share) over (order by share desc, macro) e from g)
        select macro, round(weight, 6) weight, round(share, 6) share, round(e - share, 6) "start", round(e, 6) "end", (select count(distinct doc_id) from v) valued, (select count(*) from tg) total from o""")
def creations_valuation(spark, sf_dir):
    """Every document's breakdown against the source that its number gives, valued by macro."""
    target = F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))
    rows = _complete(spark, sf_dir).where(F.col("source") == target)
    return rounded(books.creations_valuation(rows, MACROS, WEIGHTS))
