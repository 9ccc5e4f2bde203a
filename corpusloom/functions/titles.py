"""Title formats, short summaries and time labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import any_of, half_even, sentences, stripped

# Word lists of the title formats.
SUPERLATIVES = ["biggest", "best", "worst", "most", "only", "greatest", "smartest", "hardest", "easiest", "highest", "lowest"]
SECOND_PERSON = ["you're", "you are", "your", "you"]
COMMANDS = ["don'?t", "never", "always", "stop", "steal", "try", "avoid", "ask", "say", "watch", "learn", "use", "make", "build", "read", "write", "give", "create"]
QUESTION_WORDS = ["why", "how", "what", "when", "where", "does", "do", "did", "is", "are", "can", "could", "should", "would", "will"]
COMMON_ACRONYMS = ["AI", "US", "UK", "EU", "CEO", "CTO", "IPO", "TV", "OK", "ID", "PC", "VS", "API", "LLM", "GPU", "CPU", "RAM", "URL", "FAQ", "DIY", "CTA", "ETF", "GDP", "IT"]
COPULAS = ["is", "are", "was", "were"]


def title_format(title: Column) -> Column:
    """The first of the formats whose rule a title meets; null without a title.

    Marks at the ends and opening words decide first, then the shape around the first comma or colon, then words anywhere."""
    t = stripped(title)
    opens = lambda words: t.rlike(r"(?iU)^(" + "|".join(words) + r")\b")
    has = lambda words: t.rlike(any_of(words))
    common = F.array(*map(F.lit, COMMON_ACRONYMS))
    uncommon = lambda x: ~F.array_contains(common, x)
    head = stripped(F.regexp_extract(t, r"^([^,:]*)[,:]", 1))
    mark = F.regexp_extract(t, r"^[^,:]*([,:])", 1)
    acronyms = F.regexp_extract_all(t, F.lit(r"(?U)\b[A-Z]{2,6}\b"), F.lit(0))
    rules = [
        (t == "", F.lit(None)),
        (F.lower(t) == "untitled", "Untitled/Missing"),
        (t.endswith("?"), "Question"),
        (t.rlike(r"(?U)^\d+\s"), "Numbered List"),
        (opens([r"how\s+to"]), "How-To / Instructional"),
        (opens(SECOND_PERSON), "Second-Person Callout"),
        (opens(COMMANDS), "Command / Imperative"),
        ((mark != "") & head.rlike(r"^[A-Z]{2,6}\z") & uncommon(head), "Framework / Acronym Label"),
        (mark == ",", "Name/Source + Concept"),
        (mark == ":", "Topic/Concept: Elaboration"),
        (has(SUPERLATIVES), "Superlative / Ranking"),
        (t.rlike(r"(?U)\b[A-Z][a-z]+\s[A-Z][a-z]+\b|\b(?:19|20)\d{2}\b"), "Named Example / Case Study"),
        (opens(["the", "this"]), "Curiosity Gap / Teaser"),
        (opens(QUESTION_WORDS), "Question (implied)"),
        (F.exists(acronyms, uncommon), "Framework / Acronym Label"),
        (F.size(F.split(t, r"(?U)\s+")) <= 4, "Concept Label (Unattributed)"),
        (has(COPULAS), "Declarative Claim"),
    ]
    out = F.when(*rules[0])
    for met, name in rules[1:]:
        out = out.when(met, name)
    return out.otherwise("Other")


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last space, with an ellipsis where cut."""
    t = stripped(text)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*\z", ""), F.lit("…"))).otherwise(t)


def summary(text: Column, most: int = 110) -> Column:
    """The first and the last sentence, each shortened; a dash without any."""
    s = sentences(stripped(text))
    both = F.concat(shortened(F.get(s, F.lit(0)), most), F.lit(" […] "), shortened(F.get(s, F.size(s) - 1), most))
    return F.when(F.size(s) == 0, "—").when(F.size(s) == 1, shortened(F.get(s, F.lit(0)), 2 * most)).otherwise(both)


def duration_label(seconds: Column) -> Column:
    """m:ss of seconds rounded half to even."""
    s = F.bround(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def seconds_of(stamp: Column) -> Column:
    """Seconds of MM:SS or HH:MM:SS; null for anything else."""
    parts = F.transform(F.split(F.trim(stamp), ":"), lambda p: p.try_cast("long"))
    ok = F.trim(stamp).rlike(r"^\d+:\d{1,2}(:\d{1,2})?$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p))


def stamp_of(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on, of whole seconds."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(s < 3600, F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60)))


def cue_seconds(stamp: Column) -> Column:
    """Seconds of a subtitle's stamp, [H:]MM:SS with a comma or point before the fraction; null for anything else."""
    parts = F.transform(F.split(F.replace(F.trim(stamp), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    ok = F.trim(stamp).rlike(r"^(\d+:)?\d{1,2}:\d{1,2}([.,]\d+)?$")
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def number_label(n: Column) -> Column:
    """12, 3.4k, 5.6M: thousands and millions to one digit, without a zero at the end."""
    short = lambda x, sign: F.concat(F.regexp_replace(F.format_string("%.1f", half_even(x, 1)), r"\.0$", ""), F.lit(sign))
    return F.when(n >= 1e6, short(n / 1e6, "M")).when(n >= 1e3, short(n / 1e3, "k")).otherwise(F.format_string("%d", F.rint(n).cast("long")))
