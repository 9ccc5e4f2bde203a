"""The library's queries over the given tables, with SQL that gives the same rows in DuckDB.

Floating results are rounded at the end on both sides, to six digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.scoring import intrinsic
from corpusloom.operators import activity, matching, profiles
from corpusloom.sources.staging import staged
from corpusloom.streaming.spend import daily_spend

CORE = ["word_count", "beat_count", "avg_sentence_len", "median_sentence_len", "sentence_len_variance", "sentence_rhythm_cv", "closing_paragraph_ratio", "question_count", "emdash_count", "filler_count", "filler_retention", "jargon_density", "punctuation_density", "lexical_diversity", "ends_on_question"]
#: Attributes that the profile queries fingerprint.
SCORED = ["word_count", "avg_sentence_len", "sentence_len_variance", "filler_count", "punctuation_density", "lexical_diversity"]
CAPS = 500.0
#: Numeric attributes of shots that profiles hold.
SHOT_NUMBERS = ["n_shots", "mean_s", "median_s", "std_s", "shortest_percent", "short_percent", "middle_percent", "long_percent", "percent_A", "percent_N", "percent_R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def text_features_core(spark, sf_dir):
    return rounded(T.core_features(table(spark, sf_dir, "documents")).select("doc_id", *CORE))


def readability(spark, sf_dir):
    return rounded(T.readability(table(spark, sf_dir, "documents")).select("doc_id", "n_syllables", "readability_score", "book_readability"))


def regex_features(spark, sf_dir):
    df = T.pattern_features(T.core_features(table(spark, sf_dir, "documents")))
    names = ["you_freq_per_100w", "i_freq_per_100w", "we_freq_per_100w", "quote_count", "number_count", "instruction_verb_count", "framework_marker_count", "contrast_structure_count", "references_external_media", "named_entity_count", "humor_marker_count", "colloquialism_density", "word_economy_ratio"]
    return rounded(df.select("doc_id", *names))


def cta_sponsor_outro(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("t", T.stripped(F.col("text")))
    return df.select("conv_id", "turn", *(c.alias(n) for n, c in (T.call_to_action(F.col("t")) | T.sponsor(F.col("t"))).items()), T.closing_calls(F.col("t")).alias("outro_cta_count"))


def content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("content_hash"))
    return profiles.dedup(docs, "source", "content_hash", "doc_id").select("doc_id", "source", "content_hash")


def _features(spark, sf_dir) -> DataFrame:
    return T.core_features(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", *SCORED)


def _features_once(spark, sf_dir) -> DataFrame:
    """_features(), written once: for queries that read them more than once, as items and profiles or as both of a pair."""
    return staged(_features(spark, sf_dir), "features")


def _prints(spark, sf_dir, features: DataFrame | None = None) -> DataFrame:
    features = _features(spark, sf_dir) if features is None else features
    return profiles.numeric_fingerprint(profiles.long_numeric(features, ["source"], SCORED), "source")


def fingerprint_numeric(spark, sf_dir):
    return rounded(_prints(spark, sf_dir))


def fingerprint_categorical(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(profiles.categorical_fingerprint(profiles.long_categorical(docs, ["source"], ["lang", "quality", "toxic"]), "source"))


def fingerprint_hybrid(spark, sf_dir):
    weights = spark.sql("select * from values ('src0', 'mix', 0.75D), ('src1', 'mix', 0.25D) t(source, hybrid, weight)")
    return rounded(profiles.blend(_prints(spark, sf_dir), weights, "source", "hybrid"))


def _scores(spark, sf_dir) -> DataFrame:
    items = profiles.long_numeric(T.core_features(table(spark, sf_dir, "benchmark")), ["item_id"], SCORED)
    return profiles.score(items, _prints(spark, sf_dir), "item_id", "source")


def score_profiles(spark, sf_dir):
    return rounded(_scores(spark, sf_dir))


def rank_profiles(spark, sf_dir):
    """Rank all accounts for each text to score; scores are rounded first, so that ties are ties in any engine."""
    return profiles.rank(rounded(_scores(spark, sf_dir)), "item_id", "source")


def intrinsic_score(spark, sf_dir):
    df = T.grades(T.pattern_features(T.core_features(table(spark, sf_dir, "documents"))))
    total, rules = intrinsic({c: F.col(c) for c in ("word_count", "readability_score", "you_freq_per_100w", "question_count", "jargon_density", "quote_count", "beat_count", "ends_on_question")})
    return rounded(df.select("doc_id", total.alias("total_score"), F.size(F.filter(rules, lambda r: r["passed"])).alias("rules_passed")))


def profile_similarity(spark, sf_dir):
    return rounded(profiles.similarity(_prints(spark, sf_dir, _features_once(spark, sf_dir)), "source"))


def profile_drift(spark, sf_dir):
    """Drift of each source from its English texts alone to all of its texts."""
    rows = profiles.long_numeric(_features(spark, sf_dir), ["source", "lang"], SCORED)
    then = profiles.numeric_fingerprint(rows.where("lang = 'en'"), "source")
    return rounded(profiles.drift(profiles.numeric_fingerprint(rows, "source"), then, "source"))


def coverage_by_field(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = profiles.coverage(docs, ["n_chars", "quality", "toxic", "lang", "source"], ("quality", "toxic"))
    return rounded(rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_true", "n_false")}))


def _shots(spark, sf_dir) -> DataFrame:
    """Lines of orders as shots: a tenth of the quantity in seconds, the return flag as category."""
    lines = table(spark, sf_dir, "lineitem").withColumn("seconds", F.col("l_quantity") / 10)
    return activity.shot_attributes(lines, "l_orderkey", "l_linenumber", "seconds", "l_returnflag", categories=["A", "N", "R"])


def shot_attributes(spark, sf_dir):
    return rounded(_shots(spark, sf_dir))


def shot_profile(spark, sf_dir):
    """Fingerprints of customers' orders by their pace."""
    shots = _shots(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account"))
    rows = profiles.long_numeric(shots.join(orders, "l_orderkey"), ["account"], SHOT_NUMBERS)
    return rounded(profiles.numeric_fingerprint(rows, "account"))


def account_median_gated(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "value", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    return rounded(activity.gated_median(events, "user_id", ["value", "paid"]))


def axis_mode(spark, sf_dir):
    return activity.mode_with_spread(table(spark, sf_dir, "events"), "user_id", "event_type")


def usage_by_site(spark, sf_dir):
    return rounded(activity.usage(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") > 100))


def spend_by_day(spark, sf_dir):
    return rounded(daily_spend(table(spark, sf_dir, "events"), "ts", "event_type", "value", CAPS))


def gate_chain(spark, sf_dir):
    """Documents as items to process: labelled ones are classified, sources are accounts, each is due on a day of January."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    trusted = activity.trusted_accounts(docs, "source", F.col("quality") == 1, 3).withColumn("trusted", F.lit(True))
    spent = activity.over_budget(table(spark, sf_dir, "events"), "ts", "value", CAPS).select("day", "over")
    docs = docs.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")))
    docs = docs.join(trusted, "source", "left").join(spent, "day", "left")
    topic = F.when(F.col("trusted").isNull(), activity.topic_gate(F.lit(""), F.col("text"), ["tion", "ment"]))
    reason = activity.gate_chain(F.col("quality") == 0, F.nullif(F.col("source"), F.lit("src7")), F.col("n_chars") / 15.0, topic, F.col("over"))
    return docs.select("doc_id", reason.alias("reason"))


def account_cosine(spark, sf_dir):
    texts = matching.word_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, ["the", "and", "that", "with"])
    own = matching.word_rows(table(spark, sf_dir, "documents"), "source", "text", 3, ["the", "and", "that", "with"])
    return rounded(matching.account_cosine(texts, own, "item_id", "source"))


def topical_overlap(spark, sf_dir):
    texts = matching.word_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", 3, [])
    own = matching.word_rows(table(spark, sf_dir, "documents"), "source", "text", 3, [])
    return rounded(matching.topical_overlap(texts, own, "item_id", "source"))


def valuation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return rounded(activity.valuation(rows, "l_returnflag", "l_quantity"))


def weighted_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return activity.weighted_sample(docs, "source", F.col("n_chars") + 1, 3, 7, "doc_id").select("source", "doc_id", "place")


def name_keys(spark, sf_dir):
    """Accounts of two kinds by normalised name, exact and normalised matches counted."""
    a = table(spark, sf_dir, "supplier").select(T.handle(F.col("s_name")).alias("handle"), F.lit("supplier").alias("kind"))
    b = table(spark, sf_dir, "customer").select(T.handle(F.col("c_name")).alias("handle"), F.lit("customer").alias("kind"))
    return a.union(b).groupBy("handle").agg(F.count_if(F.col("kind") == "supplier").alias("suppliers"), F.count_if(F.col("kind") == "customer").alias("customers"))


def url_roster(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.clean_url(F.col("url")).alias("clean"), T.platform(F.col("url")).alias("platform"))
    return pages.select("page_id", "platform", F.substring(F.sha2("clean", 256), 1, 16).alias("url_hash"))


_ALL = (text_features_core, readability, regex_features, cta_sponsor_outro, content_dedup, fingerprint_numeric, fingerprint_categorical, fingerprint_hybrid, score_profiles, rank_profiles, intrinsic_score, profile_similarity, profile_drift, coverage_by_field, shot_attributes, shot_profile, account_median_gated, axis_mode, usage_by_site, spend_by_day, gate_chain, account_cosine, topical_overlap, valuation, weighted_sample, name_keys, url_roster)
QUERIES = {f.__name__: f for f in _ALL}

# ---- SQL ----


def _count(term: str, text: str = "low") -> str:
    quoted = term.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{quoted}', ''))) // {len(term)})"


def _even(x: str, digits: int) -> str:
    return f"(round_even(({x})::double * 1e{digits}, 0) / 1e{digits})"


def _feature_ctes(source: str) -> str:
    return rf"""
        with t as (select *, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') tx from {source}),
        p as (select *, lower(tx) low, regexp_extract_all(tx, '[A-Za-z'']+') w,
            list_filter(string_split(regexp_replace(trim(replace(tx, chr(10), ' ')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') s,
            list_filter(string_split(tx, chr(10) || chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '') pa from t),
        l as (select *, case when len(s) > 0 then list_transform(s, lambda x: len(regexp_extract_all(x, '[A-Za-z'']+'))) else [0] end lens,
            list_transform(pa, lambda x: len(regexp_extract_all(x, '[A-Za-z'']+'))) pl from p),
        m as (select *, len(w)::bigint n, len(lens) k, list_sum(lens)::bigint sm, list_sum(list_transform(lens, lambda x: x * x))::bigint sq, list_sort(lens) so from l),
        f as (select *, n word_count, len(pa)::bigint beat_count, {_even("sm / k", 2)} avg_sentence_len, (so[(k + 1) // 2] + so[k // 2 + 1]) / 2.0 median_sentence_len,
            {_even("(k * sq - sm * sm) / (k * k)", 2)} sentence_len_variance,
            {_even("case when sm > 0 then sqrt((k * sq - sm * sm) / (k * k)) * k / sm else 0.0 end", 4)} sentence_rhythm_cv,
            case when coalesce(list_sum(pl), 0) > 0 then {_even("pl[len(pl)] * len(pl) / list_sum(pl)", 3)} end closing_paragraph_ratio,
            {_count("?", "tx")}::bigint question_count, ({_count("—", "tx")} + {_count("--", "tx")})::bigint emdash_count,
            ({" + ".join(_count(x) for x in T.FILLERS)})::bigint filler_count, (filler_count > 0)::int filler_retention,
            {_even(f"case when n > 0 then ({' + '.join(_count(x) for x in T.JARGON)}) / n else 0.0 end", 4)} jargon_density,
            {_even("case when n > 0 then len(regexp_extract_all(tx, '[.,;:!?—–" + chr(92) + "-" + chr(34) + "''()]')) * 100.0 / n else 0.0 end", 2)} punctuation_density,
            {_even("case when n > 0 then len(list_distinct(list_transform(w, lambda x: lower(x)))) / n else 0.0 end", 4)} lexical_diversity,
            coalesce(ends_with(pa[len(pa)], '?'), false)::int ends_on_question from m)"""


_LONG = ", ".join(f"('{a}', f.{a}::double)" for a in SCORED)
_PRINTS = f""",
        fl as (select source, lang, v.attribute, v.value from f, lateral (values {_LONG}) v(attribute, value) where v.value is not null),
        pr as (select source, attribute, count(*) n, avg(value) mean, stddev_pop(value) std, min(value) low, max(value) high, quantile_cont(value, 0.5) median from fl group by all)"""
_SCORES = rf"""{_feature_ctes("documents")}{_PRINTS},
        {_feature_ctes("benchmark").strip()[5:].replace("t as", "t2 as", 1).replace("from t),", "from t2),").replace("p as (", "p2 as (").replace("from p),", "from p2),").replace("l as (", "l2 as (").replace("from l),", "from l2),").replace("m as (", "m2 as (").replace("f as (", "f2 as (").replace("from m)", "from m2)")},
        bl as (select item_id, v.attribute, v.value from f2, lateral (values {_LONG.replace("f.", "f2.")}) v(attribute, value) where v.value is not null),
        sub as (select item_id, source, round(case when high - low <= 1e-9 then greatest(0.0, 100 - 40 * abs(value - median) / greatest(0.15 * abs(median), 0.5))
            when value between low and high then greatest(60.0, 100 - 40 * abs(value - median) / ((high - low) / 2))
            else greatest(0.0, 60 - 40 * (case when value < low then low - value else value - high end) / (high - low)) end, 1) s from bl join pr using (attribute)),
        sc as (select item_id, source, round(avg(s), 6) score, count(s) n_attributes from sub group by all)"""


def _round(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) {n}" for n in names)


_DOUBLES = ["avg_sentence_len", "median_sentence_len", "sentence_len_variance", "sentence_rhythm_cv", "closing_paragraph_ratio", "jargon_density", "punctuation_density", "lexical_diversity"]
_STATS = _round(["mean", "std", "low", "high", "median"])
_NORMAL = r"""trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '‘’“”', '''''""'), '\s+', ' ', 'g'), '[^a-z0-9'' ]', '', 'g'))"""
_SHOTS = """
        s as (select l_orderkey, count(*) n_shots, avg(q) mean_s, quantile_cont(q, 0.5) median_s, stddev_pop(q) std_s,
            100.0 * count(*) filter (q < 1) / count(q) shortest_percent, 100.0 * count(*) filter (q < 2) / count(q) short_percent,
            100.0 * count(*) filter (q between 2 and 5) / count(q) middle_percent, 100.0 * count(*) filter (q > 5) / count(q) long_percent,
            100.0 * count(*) filter (l_returnflag = 'A') / count(*) percent_A, 100.0 * count(*) filter (l_returnflag = 'N') / count(*) percent_N, 100.0 * count(*) filter (l_returnflag = 'R') / count(*) percent_R,
            string_agg(trunc(q)::bigint::varchar, ',' order by l_linenumber, q) curve from (select *, l_quantity / 10 q from lineitem) group by all)"""
_SYLLABLES = "list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - case when ends_with(lower(x), 'e') and len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 then 1 else 0 end, 1)))"


_GRADES = f"""g as (select doc_id, y, case when n > 0 and c > 0 then {_even("0.39 * (n / c) + 11.8 * (y / n) - 15.59", 2)} else 0.0 end readability_score,
            case when n > 0 and c > 0 then {_even(f"0.39 * {_even('n / c', 2)} + 11.8 * {_even('y / n', 3)} - 15.59", 2)} end book_readability
            from (select doc_id, n, len(s) c, coalesce({_SYLLABLES}, 0)::bigint y from m))"""
#: Letters, marks and digits beyond ASCII become underscores, word characters that no pattern names, as RE2 knows ASCII words alone.
_ASCII = r"regexp_replace(tx, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g')"


def _re(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def _hits(pattern: str, text: str = "ax") -> str:
    return f"len(regexp_extract_all({text}, '{_re(pattern)}'))::bigint"


_PATTERN_INTS = ["quote_count", "number_count", "instruction_verb_count", "framework_marker_count", "contrast_structure_count", "references_external_media", "named_entity_count", "humor_marker_count"]
_PATTERN_DOUBLES = ["you_freq_per_100w", "i_freq_per_100w", "we_freq_per_100w", "colloquialism_density", "word_economy_ratio"]
_per100 = lambda pattern: _even(f"case when n > 0 then {_hits(pattern)} * 100.0 / n else 0.0 end", 2)
_PATTERN_CTES = f"""q as (select *, {_ASCII} ax from f),
        r0 as (select *, {_per100(T.YOU)} you_freq_per_100w, {_per100(T.I_WORD)} i_freq_per_100w, {_per100(T.WE)} we_freq_per_100w, {_hits(T.QUOTE, "tx")} quote_count, {_hits(T.NUMBER)} number_count,
            {_hits(T.any_of(T.INSTRUCTIONS))} instruction_verb_count, {_hits(T.STEPS)} framework_marker_count, {_hits(T.CONTRAST)} contrast_structure_count,
            regexp_matches(ax, '{_re(T.MEDIA)}')::int references_external_media, len(list_distinct(regexp_extract_all(ax, '{_re(T.ENTITY)}')))::bigint named_entity_count,
            ({_hits(T.any_of(T.HUMOR))} + {_count("!", "tx")})::bigint humor_marker_count, {_per100(T.COLLOQUIALISM)} colloquialism_density from q),
        r as (select *, case when instruction_verb_count + framework_marker_count + number_count > 0 then {_even("filler_count / (instruction_verb_count + framework_marker_count + number_count)", 3)} else filler_count::double end word_economy_ratio from r0)"""
_first_at = lambda p: f"case when regexp_matches(ax, '{_re(p)}') then length(regexp_extract(ax, '(?s)^(.*?)(?:{_re(p)})', 1)) end"
_late = lambda p: f"len(list_filter(list_transform(range(1, len(regexp_extract_all(ax, '{_re(p)}')) + 1), lambda i: list_sum(list_transform(string_split_regex(ax, '{_re(p)}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(ax, '{_re(p)}')[1:i - 1], lambda x: length(x))), 0)), lambda b: b >= 0.9 * length(ax)))"
_CTA = rf"""with t as (select conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') tx from conversations),
        q as (select *, {_ASCII} ax from t),
        c as (select *, [{", ".join(_hits(p) for _, p in T.CALLS)}] n, [{", ".join(_first_at(p) for _, p in T.CALLS)}] fa, {_first_at(T.SPONSOR)} sp, ({" + ".join(_late(p) for _, p in T.CALLS)})::bigint late from q),
        e as (select *, list_sum(n)::bigint total, list_min(list_filter(fa, lambda x: x is not null)) / length(ax) share from c)
        select conv_id, turn, (total > 0)::int has_cta, case when total = 0 then 'None' else [{", ".join(f"'{k}'" for k, _ in T.CALLS)}][list_position(n, list_max(n))] end cta_type,
            case when total = 0 then 'None' when share < 1 / 3 then 'Start' when share < 2 / 3 then 'Mid' else 'End' end cta_placement, total cta_count, (sp is not null)::int sponsor_segment_present,
            case when sp is null then 'none' when sp / length(ax) < 1 / 3 then 'early' when sp / length(ax) < 2 / 3 then 'mid' else 'late' end sponsor_segment_position, late outro_cta_count from e"""


def _cosine_words(source: str, key: str, stop: str = "") -> str:
    return f"select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')) word from {source}"


ORACLE_SQL = {
    "text_features_core": _feature_ctes("documents") + f" select doc_id, word_count, beat_count, question_count, emdash_count, filler_count, filler_retention, ends_on_question, {_round(_DOUBLES)} from f",
    "readability": _feature_ctes("documents") + f", {_GRADES} select doc_id, y n_syllables, readability_score, round(book_readability, 6) book_readability from g",
    "regex_features": _feature_ctes("documents") + f", {_PATTERN_CTES} select doc_id, {', '.join(_PATTERN_INTS)}, {_round(_PATTERN_DOUBLES)} from r",
    "intrinsic_score": _feature_ctes("documents") + f""", {_PATTERN_CTES}, {_GRADES.replace("from m", "from m")},
        e as (select r.doc_id, [word_count between 150 and 350, readability_score between 6 and 11, you_freq_per_100w >= 1.5, question_count >= 1, jargon_density <= 0.03, quote_count >= 1, beat_count >= 3, ends_on_question = 1] p from r join g using (doc_id))
        select doc_id, round(list_sum(list_transform(p, lambda x, i: case when x then [15, 15, 15, 10, 15, 10, 10, 10][i] else 0 end)) * 100.0 / 100, 6) total_score, len(list_filter(p, lambda x: x))::int rules_passed from e""",
    "cta_sponsor_outro": _CTA,
    "content_dedup": f"with h as (select doc_id, source, sha256({_NORMAL}) content_hash from documents) select min(doc_id) doc_id, source, content_hash from h group by source, content_hash",
    "fingerprint_numeric": _feature_ctes("documents") + _PRINTS + f" select source, attribute, n, {_STATS} from pr",
    "fingerprint_categorical": """with d as (select source, lang, quality::varchar quality, toxic::varchar toxic from documents left join labels using (doc_id)),
        v as (select source, x.attribute, x.value from d, lateral (values ('lang', lang), ('quality', quality), ('toxic', toxic)) x(attribute, value) where x.value is not null),
        c as (select source, attribute, value, count(*) n from v group by all)
        select source, attribute, value, n, """ + _even("100.0 * n / sum(n) over (partition by source, attribute)", 1) + " share from c",
    "fingerprint_hybrid": _feature_ctes("documents") + _PRINTS + ", b as (select *, case source when 'src0' then 0.75 when 'src1' then 0.25 end::double wt from pr) select 'mix' as hybrid, attribute, count(*) sources, " + ", ".join(f"round(sum({c} * wt) / sum(wt), 3) {c}" for c in ("mean", "std", "low", "high", "median")) + " from b where wt is not null group by attribute",
    "score_profiles": _SCORES + " select * from sc",
    "rank_profiles": _SCORES + " select *, row_number() over (partition by item_id order by score desc, source)::int place from sc",
    "profile_similarity": _feature_ctes("documents") + _PRINTS + " select a.source a, b.source b, round(avg(1 - least(abs(a.mean - b.mean) / greatest(abs(a.mean), abs(b.mean), 1e-6), 1.0)), 6) similarity, count(*) n_attributes from pr a join pr b on a.attribute = b.attribute and a.source < b.source group by all",
    "profile_drift": _feature_ctes("documents") + _PRINTS + ", o as (select source, attribute, avg(value) before from fl where lang = 'en' group by all) select source, attribute, round(before, 6) before, round(mean, 6) after, " + _even("mean - before", 3) + " delta, case when before <> 0 then " + _even("100 * " + _even("mean - before", 3) + " / abs(before)", 1) + " end percent from o join pr using (source, attribute)",
    "coverage_by_field": """with d as (select n_chars, quality, toxic, lang, source from documents left join labels using (doc_id)),
        v as (select x.attribute, x.kind, x.value, case when kind <> 'text' then x.value::double end n from d, lateral (values ('n_chars', 'number', n_chars::varchar), ('quality', 'flag', quality::varchar), ('toxic', 'flag', toxic::varchar), ('lang', 'text', lang), ('source', 'text', source)) x(attribute, kind, value))
        select attribute, kind, count(value) filled, round(100.0 * count(value) / count(*), 6) percent, min(n) filter (kind = 'number') low, max(n) filter (kind = 'number') high, round(avg(n) filter (kind = 'number'), 6) mean, count(distinct value) n_values,
            count(*) filter (kind = 'flag' and n <> 0) n_true, count(*) filter (kind = 'flag' and n = 0) n_false from v group by attribute, kind""",
    "shot_attributes": f"""with {_SHOTS},
        c as (select l_orderkey, l_returnflag, count(*) n, min(l_linenumber) f from lineitem group by all),
        g as (select l_orderkey, l_returnflag main_category from c qualify row_number() over (partition by l_orderkey order by n desc, f, l_returnflag) = 1)
        select l_orderkey, n_shots, curve, main_category, {_round(SHOT_NUMBERS[1:])} from s join g using (l_orderkey)""",
    "shot_profile": f"""with {_SHOTS},
        v as (select o_custkey account, x.attribute, x.value from s join orders on o_orderkey = l_orderkey, lateral (values {", ".join(f"('{a}', {a}::double)" for a in SHOT_NUMBERS)}) x(attribute, value) where x.value is not null),
        pr as (select account, attribute, count(*) n, avg(value) mean, stddev_pop(value) std, min(value) low, max(value) high, quantile_cont(value, 0.5) median from v group by all)
        select account, attribute, n, {_STATS} from pr""",
    "account_median_gated": """with e as (select user_id, value, case when event_type = 'purchase' then value end paid from events)
        select user_id, round(case when 2 * count(value) >= count(*) then quantile_cont(value, 0.5) end, 6) as value, count(value) || '/' || count(*) value_coverage,
            round(case when 2 * count(paid) >= count(*) then quantile_cont(paid, 0.5) end, 6) paid, count(paid) || '/' || count(*) paid_coverage from e group by user_id""",
    "axis_mode": """with c as (select user_id, event_type v, count(*) n from events where event_type is not null group by all)
        select user_id, first(v order by n desc, v) as value, string_agg(v || ' ' || n, ', ' order by n desc, v) note, sum(n)::bigint n_rows, sum(n) >= 3 confirmed from c group by user_id""",
    "usage_by_site": """with e as (select event_type site, case when value > 100 then 'large' else 'usual' end size, value from events)
        select site, size, count(*) n, round(avg(value), 6) mean_cost, round(sum(value), 6) total_cost from e group by rollup (site, size)""",
    "spend_by_day": f"select date_trunc('day', ts)::timestamp as day, event_type site, count(*) n, round(sum(value), 6) spent, sum(value) >= {CAPS} over_cap from events group by all",
    "account_cosine": f"""with a as ({_cosine_words("benchmark", "item_id")}), b as ({_cosine_words("documents", "source")}),
        x as (select item_id, word, count(*) x from a where word not in ('the', 'and', 'that', 'with') group by all), y as (select source, word, count(*) y from b where word not in ('the', 'and', 'that', 'with') group by all),
        nx as (select item_id, sqrt(sum(x * x)) nx from x group by all), ny as (select source, sqrt(sum(y * y)) ny from y group by all)
        select item_id, source, round(sum(x * y) / (any_value(nx) * any_value(ny)), 6) cosine from x join y using (word) join nx using (item_id) join ny using (source) group by item_id, source""",
    "topical_overlap": f"""with a as (select distinct * from ({_cosine_words("benchmark", "item_id")})), b as (select distinct * from ({_cosine_words("documents", "source")})), n as (select item_id, count(*) n from a group by all)
        select item_id, source, count(*) shared, round(count(*) / any_value(n), 6) overlap from a join b using (word) join n using (item_id) group by item_id, source""",
    "valuation": """with g as (select l_returnflag, sum(l_quantity) weight from lineitem group by all), s as (select *, 100.0 * weight / sum(weight) over () share from g),
        c as (select *, sum(share) over (order by share desc, l_returnflag) as "end" from s)
        select l_returnflag, round(weight, 6) weight, round(share, 6) share, round("end", 6) "end", round("end" - share, 6) as start from c""",
    "name_keys": """with n as (select s_name x, 1 s, 0 c from supplier union all select c_name, 0, 1 from customer)
        select regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]', '', 'g') handle, sum(s)::bigint suppliers, sum(c)::bigint customers from n group by all""",
    "url_roster": r"""select page_id, case when l like '%instagram.com%' then 'Instagram' when l like '%youtube.com%' or l like '%youtu.be%' then 'YouTube' when l like '%facebook.com%' or l like '%fb.watch%' then 'Facebook' when l like '%tiktok.com%' then 'TikTok' else 'Web' end platform,
        substr(sha256(lower(regexp_replace(string_split(coalesce(url, ''), '?')[1], '/+$', ''))), 1, 16) url_hash from (select *, lower(coalesce(url, '')) l from pages)""",
    "gate_chain": rf"""with b as (select doc_id, lang, source, text, n_chars / 15.0 sec, quality, date '2024-01-01' + (doc_id % 30)::int as day from documents left join labels using (doc_id)),
        tr as (select source from b group by source having count(*) filter (quality = 1) >= 3), sp as (select ts::date as day, sum(value) >= {CAPS} over_cap from events group by all),
        d as (select *, source in (select source from tr) trusted, array_to_string(string_split_regex(lower(coalesce(text, '')), '\s+')[1:600], ' ') head from b left join sp using (day))
        select doc_id, coalesce(case when quality = 0 then 'already_classified' end, case when source is null or source = 'src7' then 'no_account' end, case when sec > 3600 then 'too_long' when sec < 5 then 'too_short' end,
            case when not coalesce(trusted, false) and not (contains(head, 'tion') or contains(head, 'ment')) then 'off_topic' end, case when over_cap then 'over_budget' end) reason from d""",
}
