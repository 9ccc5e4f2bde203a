from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, text, make):
    return make(spark.createDataFrame([(text,)], "text string")).first()


def test_paragraphs_and_closing_question(spark):
    r = one(spark, "One two three. Four.\n\nFive six.\n\nSeven eight nine ten?", T.core_features)
    assert (r.word_count, r.beat_count, r.question_count, r.ends_on_question) == (10, 3, 1, 1)
    assert abs(r.closing_paragraph_ratio - 4 / (10 / 3)) < 1e-9
    assert r.median_sentence_len == 2.5


def test_empty_texts(spark):
    for text in ("", "  \n ", None):
        r = one(spark, text, T.core_features)
        assert (r.word_count, r.avg_sentence_len, r.jargon_density, r.lexical_diversity, r.closing_paragraph_ratio) == (0, 0.0, 0.0, 0.0, None)


def test_syllables(spark):
    rows = spark.createDataFrame([("the", 1), ("make", 1), ("rhythm", 1), ("hmm", 1), ("banana", 3), ("agree", 1)], "w string, n int")
    assert rows.where(T.syllables(F.col("w")) != F.col("n")).count() == 0


def test_fillers_are_substrings_and_yourself_is_no_you(spark):
    r = one(spark, "Also, he went so, well. Yours and you're; yourself.", lambda d: T.pattern_features(T.core_features(d)))
    assert r.filler_count == 2  # "so," inside "also," too
    assert r.you_freq_per_100w == round(100 * 2 / r.word_count, 2)  # two digits, as the rule says


def test_call_to_action_tie_and_place(spark):
    text = "Subscribe now. " + "word " * 40 + "let me know"
    r = one(spark, text, lambda d: d.select(*(c.alias(n) for n, c in T.call_to_action(F.col("text")).items()), T.closing_calls(F.col("text")).alias("late")))
    assert (r.has_cta, r.cta_type, r.cta_placement, r.cta_count, r.late) == (1, "Comment-bait question", "Start", 2, 1)


def test_names_and_urls(spark):
    r = one(spark, "Tom &amp; Jerry's", lambda d: d.select(T.handle(F.col("text")).alias("h")))
    assert r.h == "tomjerrys"
    r = one(spark, "https://X.com/a/?q=1", lambda d: d.select(T.clean_url(F.col("text")).alias("u"), T.platform(F.lit("https://youtu.be/1")).alias("p")))
    assert (r.u, r.p) == ("https://x.com/a", "YouTube")


def test_patterns_are_searched_only_where_their_words_stand(spark):
    texts = ["Take it, TRY it; pee\u017f, \u017fquint and not this, but p\u0131ck or P\u0130CTURE", "hold", "The fir\u017ft thing, third  Reason, rule number 4 and STEP one", "Rather than that, a\u017f opposed to it", "WATCH TH\u0130S, this Video", "lo\u212a, loo\u212a and \u212aidding", "HAHA, lol: it's O\u212a, you'd say", "Y\u039fU or YOU", "not one. but two", "", None, "nothing of it", "I\u0307magine the sixth\u00a0point"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    df = T.pattern_features(T.core_features(frame))
    t, n = F.col("_text"), F.col("word_count")
    plain = {
        "you_freq_per_100w": T.half_even(T.ratio(T.hits(t, T.YOU) * 100.0, n), 2),
        "instruction_verb_count": T.hits(t, T.any_of(T.INSTRUCTIONS)),
        "framework_marker_count": T.hits(t, T.STEPS),
        "contrast_structure_count": T.hits(t, T.CONTRAST),
        "references_external_media": t.rlike(T.MEDIA).cast("int"),
        "humor_marker_count": T.hits(t, T.any_of(T.HUMOR)) + T.literal_hits(t, ["!"]),
        "colloquialism_density": T.half_even(T.ratio(T.hits(t, T.COLLOQUIALISM) * 100.0, n), 2),
    }
    rows = df.select(*plain, *(c.alias(f"plain_{k}") for k, c in plain.items())).collect()
    for k in plain:
        assert [r[k] for r in rows] == [r[f"plain_{k}"] for r in rows] and any(r[k] for r in rows), k
    plan = df.select(*plain)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(_low#{i}, {w})" in plan for i in [plan.split("Contains(_low#")[1].split(",")[0]] for w in ("grab", "rule", "rather than", "this", "kidding", "folks"))
