"""Text features as Column expressions: one projection, no UDF.

Densities of an empty text are 0; a null text counts as empty. Averages and densities are rounded half to even: two
digits for lengths, grades and densities by 100 words, four for rhythm, jargon and diversity, three for other ratios.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists of the features.
FILLERS = ["well,", "i mean", "you know", "right,", "so,", "actually,", "basically,"]
INSTRUCTIONS = ["take", "try", "imagine", "picture", "hold", "look", "notice", "pick", "grab", "close your", "point", "guess", "use your", "peer", "squint", "cover"]
COLLOQUIAL = ["gonna", "wanna", "kinda", "sorta", "yeah", "okay", "ok", "stuff", "guys", "totally", "literally", "honestly", "super", "folks"]
JARGON = ["epistemic", "ontology", "dialectic", "utilitarian", "deontological", "asabiyyah", "telic", "atelic", "hegemony", "praxis", "phenomenology", "heuristic", "cognitive bias", "externality", "elasticity", "marginal", "equilibrium", "hegemonic", "paradigm", "normative", "empirical", "stoic", "nihilism", "existentialism", "transcendentalism"]
HUMOR = ["haha", "lol", "joking", "kidding", "hilarious", "just kidding"]
STEP_NOUNS = ["step", "number", "element", "rule"]
STEP_NUMBERS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "one", "two", "three", "four", "five", "six", "seven", "eight", "1", "2", "3", "4", "5"]

# Patterns of the features. They are Unicode-aware, as \b is ASCII otherwise from JDK 19 on.
WORD = r"[A-Za-z']+"
YOU = r"(?iU)\byou(r|rs|self)?\b"
I_WORD = r"(?U)\bI\b"
WE = r"(?iU)\bwe('re|'ll|'d|'ve)?\b"
QUOTE = r"[‘“\"'][^’”\"']{3,}[’”\"']"
NUMBER = r"(?U)\b\d+(?:[.,]\d+)*%?\b"
CONTRAST = r"(?iU)\b(instead of|rather than|as opposed to)\b|\bnot\b[^.?!]{1,40}\bbut\b"
MEDIA = r"(?iU)\b(this clip|this footage|this recording|this speech|watch this|this video)\b"
ENTITY = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
#: What lower case leaves of letters that match an ASCII one where case is ignored: dotless i, long s, the dot of a capital I.
ODD_CASE = ["ı", "ſ", "\u0307"]
PUNCTUATION = r"[.,;:!?—–\-\"'()]"
COMMENT = r"(?iU)\b(comment below|let me know|what do you think|drop a comment|comment your|tell me in the comments|let us know)\b"
FOLLOW = r"(?iU)\b(follow|subscribe|hit (?:that |the )?follow|smash (?:that |the )?(?:like|follow)|turn on notifications)\b"
PLUG = r"(?iU)\b(newsletter|link in (?:my |the )?bio|check out my|sign up|join my|buy my|my book|my course|my podcast|my substack)\b"
SPONSOR = r"(?iU)\b(sponsored by|brought to you by|today'?s sponsor|thanks to .{1,40} for sponsoring|paid partnership|in partnership with|use code|use my code|special discount|this episode is sponsored)\b"
CALLS = [("Comment-bait question", COMMENT), ("Follow/subscribe", FOLLOW), ("Newsletter/product plug", PLUG)]


def any_of(words: list[str]) -> str:
    return r"(?iU)\b(" + "|".join(words) + r")\b"


STEPS = r"(?iU)\b(?:" + "|".join(STEP_NOUNS) + r")\s*(?:number\s+)?(?:" + "|".join(STEP_NUMBERS) + r")\b|\b(?:the\s+)?(?:" + "|".join(STEP_NUMBERS[:6]) + r")\s+(?:thing|reason|element|step|point)\b"


COLLOQUIALISM = r"(?iU)\b\w+'(?:t|s|re|ve|ll|d|m)\b|" + any_of(COLLOQUIAL)[5:]


def title_features(title: Column) -> dict[str, Column]:
    """title_word_count (null without a title) and title_names_source (a comma in the title)."""
    some = F.coalesce(title, F.lit("")) != ""
    return {"title_word_count": F.when(some, F.size(words(title)).cast("long")), "title_names_source": F.when(some & F.contains(title, F.lit(",")), 1).otherwise(0)}


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def literal_hits(text: Column, terms: list[str]) -> Column:
    """Non-overlapping occurrences of each term as a substring, summed."""
    found = lambda t: ((F.length(text) - F.length(F.replace(text, F.lit(t)))) / len(t)).cast("long")
    parts = [F.when(F.contains(text, F.lit(t)), found(t)).otherwise(F.lit(0).cast("long")) for t in terms]
    return sum(parts[1:], parts[0])


def holds(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms stands in the text."""
    parts = [F.contains(text, F.lit(t)) for t in terms]
    return reduce(lambda a, b: a | b, parts)


def sentences(text: Column) -> Column:
    flat = stripped(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")


def syllables(word: Column) -> Column:
    """Groups of vowels, less a final e where there are more, one at least."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    return F.greatest(groups - F.when(low.endswith("e") & (groups > 1), 1).otherwise(0), F.lit(1)).cast("long")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def half_even(value: Column, digits: int) -> Column:
    return F.rint(value * 10.0**digits) / 10.0**digits


def median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    at = lambda k: F.get(sorted_values, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0


def normalised(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, letters, digits, apostrophes and spaces alone."""
    straight = F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(F.regexp_replace(straight, r"\s+", " "), r"[^a-z0-9' ]", ""))


def has_normalised(text: Column) -> Column:
    """Whether normalised() leaves anything, without writing it."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("[a-z0-9'‘’]")


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def handle(name: Column) -> Column:
    """An account name for comparison: entities undone, lower case, letters and digits alone."""
    out = F.coalesce(name, F.lit(""))
    for entity, sign in (("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.lower(out), "[^a-z0-9]", "")


def clean_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), "/+$", ""))


def platform(url: Column, default: str = "Web") -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    named = [("instagram.com", "Instagram"), ("youtube.com", "YouTube"), ("youtu.be", "YouTube"), ("facebook.com", "Facebook"), ("fb.watch", "Facebook"), ("tiktok.com", "TikTok")]
    out = F.lit(default)
    for part, name in reversed(named):
        out = F.when(low.contains(part), name).otherwise(out)
    return out


def call_to_action(text: Column) -> dict[str, Column]:
    """has_cta, cta_type (most hits; the earlier kind at a tie), cta_placement (thirds of the characters), cta_count."""
    counts = [hits(text, p) for _, p in CALLS]
    most, n = F.greatest(*counts), sum(counts[1:], counts[0])
    kind = F.lit("None")
    for (name, _), c in reversed(list(zip(CALLS, counts, strict=True))):
        kind = F.when((n > 0) & (c == most), name).otherwise(kind)
    first = F.least(*(F.when(c > 0, F.regexp_instr(text, F.lit(p)) - 1) for (_, p), c in zip(CALLS, counts, strict=True)))
    share = first / F.length(text)
    place = F.when(n == 0, "None").when(share < 1 / 3, "Start").when(share < 2 / 3, "Mid").otherwise("End")
    return {"has_cta": (n > 0).cast("int"), "cta_type": kind, "cta_placement": place, "cta_count": n}


def sponsor(text: Column) -> dict[str, Column]:
    n = hits(text, SPONSOR)
    share = (F.regexp_instr(text, F.lit(SPONSOR)) - 1) / F.length(text)
    return {"sponsor_segment_present": (n > 0).cast("int"), "sponsor_segment_position": F.when(n == 0, "none").when(share < 1 / 3, "early").when(share < 2 / 3, "mid").otherwise("late")}


def closing_calls(text: Column) -> Column:
    """Calls to action that start in the last tenth of the characters: starts are the lengths of what stands before."""

    def late(pattern: str) -> Column:
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        before = lambda i: total(F.transform(F.slice(between, 1, i + 1), F.length)) + total(F.transform(F.slice(found, F.lit(1), i), F.length))
        return F.size(F.filter(F.transform(found, lambda m, i: before(i)), lambda s: s >= 0.9 * F.length(text)))

    return sum((late(p) for _, p in CALLS[1:]), late(CALLS[0][1])).cast("long")


def lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _text, _words, _sentences, _lens (words of each sentence, sorted; [0] without a sentence) and _paras."""
    df = df.withColumn("_text", stripped(F.col(text)))
    df = df.withColumns({"_words": words(F.col("_text")), "_sentences": sentences(F.col("_text")), "_paras": paragraphs(F.col("_text"))})
    lens = F.sort_array(F.transform("_sentences", lambda s: F.size(words(s))))
    return df.withColumn("_lens", F.when(F.size("_sentences") > 0, lens).otherwise(F.array(F.lit(0))))


def core_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, sentence lengths, rhythm, diversity."""
    df = lengths(df, text).withColumn("_low", F.lower("_text"))
    n, k = F.size("_words").cast("long"), F.size("_lens").cast("long")
    sums, squares = total(F.col("_lens")), total(F.transform("_lens", lambda x: x * x))
    df = df.withColumns({"word_count": n, "beat_count": F.size("_paras").cast("long"), "_k": k, "_sum": sums, "_sq": squares})
    spread = (F.col("_k") * F.col("_sq") - F.col("_sum") * F.col("_sum")) / (F.col("_k") * F.col("_k"))
    paras = F.transform("_paras", lambda p: F.size(words(p)))
    t, low = F.col("_text"), F.col("_low")
    return df.withColumns(
        {
            "avg_sentence_len": half_even(F.col("_sum") / F.col("_k"), 2),
            "median_sentence_len": median(F.col("_lens")),
            "sentence_len_variance": half_even(spread, 2),
            "sentence_rhythm_cv": half_even(ratio(F.sqrt(spread) * F.col("_k"), F.col("_sum")), 4),
            "closing_paragraph_ratio": F.when(total(paras) > 0, half_even(F.get(paras, F.size("_paras") - 1) * F.size("_paras") / total(paras), 3)),
            "question_count": literal_hits(t, ["?"]),
            "emdash_count": literal_hits(t, ["—", "--"]),
            "filler_count": literal_hits(low, FILLERS),
            "filler_retention": (literal_hits(low, FILLERS) > 0).cast("int"),
            "jargon_density": half_even(ratio(literal_hits(low, JARGON).cast("double"), F.col("word_count")), 4),
            "punctuation_density": half_even(ratio(hits(t, PUNCTUATION) * 100.0, F.col("word_count")), 2),
            "lexical_diversity": half_even(ratio(F.size(F.array_distinct(F.transform("_words", F.lower))).cast("double"), F.col("word_count")), 4),
            "ends_on_question": F.coalesce(F.get("_paras", F.size("_paras") - 1).endswith("?").cast("int"), F.lit(0)),
        }
    )


def readability(df: DataFrame, text: str = "text") -> DataFrame:
    """readability_score (0 for empty texts) and book_readability (over averages rounded before; null for empty texts)."""
    return grades(lengths(df, text))


def grades(df: DataFrame) -> DataFrame:
    """readability() of a table that holds what lengths() or core_features() adds."""
    df = df.withColumn("_syl", total(F.transform("_words", syllables)))
    n, s = F.size("_words"), F.size("_sentences")
    some = (n > 0) & (s > 0)
    grade = 0.39 * (n / s) + 11.8 * (F.col("_syl") / n) - 15.59
    book = 0.39 * half_even(n / s, 2) + 11.8 * half_even(F.col("_syl") / n, 3) - 15.59
    return df.withColumns({"n_syllables": F.col("_syl"), "readability_score": F.when(some, half_even(grade, 2)).otherwise(0.0), "book_readability": F.when(some, half_even(book, 2))})


def pattern_features(df: DataFrame) -> DataFrame:
    """Features by patterns, after core_features(). Patterns that try many words at each place are searched only where
    words that they can't do without stand in the text (or letters that are odd in case, which could stand for theirs)."""
    df = df.withColumn("_odd", holds(F.col("_low"), ODD_CASE))
    t, n = F.col("_text"), F.col("word_count")
    seen = lambda *terms: holds(F.col("_low"), terms)
    hits_where = lambda some, pattern: F.when(F.col("_odd") | some, hits(t, pattern)).otherwise(F.lit(0).cast("long"))
    verbs, numbers = hits_where(seen(*INSTRUCTIONS), any_of(INSTRUCTIONS)), hits(t, NUMBER)
    steps = hits_where(seen(*STEP_NOUNS) | (seen(*STEP_NUMBERS[:6]) & seen("thing", "reason", "element", "step", "point")), STEPS)
    each = {
        "you_freq_per_100w": half_even(ratio(hits_where(seen("you"), YOU) * 100.0, n), 2),
        "i_freq_per_100w": half_even(ratio(hits(t, I_WORD) * 100.0, n), 2),
        "we_freq_per_100w": half_even(ratio(hits(t, WE) * 100.0, n), 2),
        "quote_count": hits(t, QUOTE),
        "number_count": numbers,
        "instruction_verb_count": verbs,
        "framework_marker_count": steps,
        "contrast_structure_count": hits_where(seen("instead of", "rather than", "as opposed to") | (seen("not") & seen("but")), CONTRAST),
        "references_external_media": F.when(F.col("_odd") | seen("this"), t.rlike(MEDIA).cast("int")).otherwise(0),
        "named_entity_count": F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)))).cast("long"),
        "humor_marker_count": hits_where(seen(*HUMOR), any_of(HUMOR)) + literal_hits(t, ["!"]),
        "colloquialism_density": half_even(ratio(hits_where(seen("'", *COLLOQUIAL), COLLOQUIALISM) * 100.0, n), 2),
    }
    df = df.withColumns(each)
    useful = F.col("instruction_verb_count") + F.col("framework_marker_count") + F.col("number_count")
    return df.withColumn("word_economy_ratio", F.when(useful > 0, half_even(F.col("filler_count") / useful, 3)).otherwise(F.col("filler_count").cast("double")))
