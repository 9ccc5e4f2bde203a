from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusloom.functions import titles
from corpusloom.operators import matching, timing, upkeep
from corpusloom.plans import library
from corpusloom.streaming.ingest import ingest

TITLES = {
    "": None,
    "Untitled": "Untitled/Missing",
    "Is it so?": "Question",
    "5 rules of trade": "Numbered List",
    "How to think": "How-To / Instructional",
    "Your mind, explained": "Second-Person Callout",
    "Don't do it": "Command / Imperative",
    "SWOT: a tool": "Framework / Acronym Label",
    "AI: the end": "Topic/Concept: Elaboration",
    "Plato, on caves": "Name/Source + Concept",
    "Markets and the biggest lie": "Superlative / Ranking",
    "When John Smith left": "Named Example / Case Study",
    "The thing nobody sees": "Curiosity Gap / Teaser",
    "Why we sleep": "Question (implied)",
    "Meet SWOT": "Framework / Acronym Label",
    "Quiet power": "Concept Label (Unattributed)",
    "Money for all people is over": "Declarative Claim",
    "Money for all people and more": "Other",
}


def test_title_formats(spark):
    rows = spark.createDataFrame(list(TITLES.items()), "t string, want string").withColumn("got", titles.title_format(F.col("t"))).collect()
    assert [(r.t, r.got) for r in rows] == list(TITLES.items())


def test_labels_and_summary(spark):
    r = spark.range(1).select(titles.duration_label(F.lit(125.5)), titles.seconds_of(F.lit("1:02:03")), titles.seconds_of(F.lit("x")), titles.summary(F.lit("One. Two. Three.")), titles.summary(F.lit(" ")), titles.shortened(F.lit("aa bb cc"), 4)).first()
    assert tuple(r) == ("2:06", 3723, None, "One. […] Three.", "—", "aa…")


def test_marked_transcript(spark):
    cues = spark.createDataFrame([([(0.0, "a b c"), (61.0, "d e"), (70.0, " "), (130.0, "f")],)], "cues array<struct<start:double,text:string>>")
    assert cues.select(timing.marked_transcript(F.col("cues"), 5)).first()[0] == "[00:00] a b c d e [02:10] f"


def test_chapter_times(spark):
    schema = "k long, duration double, cues array<struct<start:double,text:string>>, sections array<struct<title:string,summary:string,points:array<string>>>"
    cues = [(0.0, "apples are sweet"), (10.0, "apples rivers and mountains"), (20.0, "rivers mountains valleys"), (30.0, "engines")]
    sections = [("Opening", "apples", None), ("Rivers mountains valleys", None, []), ("Apples", None, None), ("Nothing known", "zebra", None)]
    rows = spark.createDataFrame([(1, 40.0, cues, sections), (2, None, None, None), (3, 30.0, [], sections[:2])], schema)
    got = {r.k: [tuple(t) for t in r.times] for r in timing.chapter_times(rows, "k").collect()}
    # the third matches nothing ahead and its share (20 s) isn't past the second: pushed by 2.5 s
    assert got[1] == [(0.0, 20.0, "matched", 1.0), (20.0, 22.5, "matched", 1.0), (22.5, 30.0, "allocated", 0.0), (30.0, 40.0, "allocated", 0.0)]
    assert got[2] == []
    assert got[3] == [(0.0, 15.0, "allocated", 1.0), (15.0, 30.0, "allocated", 0.0)]


def test_videos_hold_every_sentence(spark, tmp_path):
    said = [f"Sentence {w} tells of {w} matters." for w in ("alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey").split()]
    texts = [(1, " ".join(said)), (2, "Only one."), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.transcript for r in library.marked_transcripts(spark, str(tmp_path)).collect()}
    marked = [f"[{5 * k // 60:02d}:{5 * k % 60:02d}] {x}" if k % 7 == 0 else x for k, x in enumerate(said)]  # 6 words each
    assert got == {1: " ".join(marked), 2: "[00:00] Only one.", 3: ""}
    times = [tuple(r) for r in library.chapter_times(spark, str(tmp_path)).where("doc_id = 1").orderBy("chapter").collect()]
    assert times == [(1, 0, 0.0, 100.0, "matched", 1.0), (1, 1, 100.0, 115.0, "matched", times[1][5])]


def test_names_against_brute_force(spark):
    known = ["Kyla Scan", "robert willis", "philosophy minis", "Ann", "Bo", "économie", "The Long History", "longhistory the"]
    incoming = ["Kyla Scan", "kylascan", "kyla scann", "Robert Wilis", "philosophyminis!", "an", "b o", "The Log History", "zebra", "", None]
    norm = lambda s: "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    want = {}
    for n in filter(lambda x: x is not None, incoming):
        equal = [k for k in known if norm(k) == norm(n)]
        near = [(-SequenceMatcher(None, norm(n), norm(k)).ratio(), k) for k in known]
        want[n] = ("exact", None) if n in known else ("similar", min(equal)) if equal else ("similar", min(near)[1]) if -min(near)[0] >= 0.82 else ("new", None)
    a, b = (spark.createDataFrame([(x,) for x in v], "name string") for v in (incoming, known))
    got = matching.resolve_names(a, b, "name", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")).collect()
    assert {r.name: (r.status, r.suggestion) for r in got} == want


def test_upsert_children_and_codes(spark):
    old = spark.createDataFrame([(1, "a", "t"), (2, "b", "u")], "k long, v string, title string")
    new = spark.createDataFrame([(2, None, None), (3, "c", None)], "k long, v string, title string")
    got = {r.k: (r.v, r.title, r.change) for r in upkeep.upsert(old, new, ["k"], ["v"], ["title"]).collect()}
    assert got == {1: ("a", "t", "kept"), 2: (None, "u", "updated"), 3: ("c", None, "inserted")}
    kids = upkeep.replace_children(old, new.where("k = 2"), "k").collect()
    assert sorted((r.k, r.v) for r in kids) == [(1, "a"), (2, None)]
    assert upkeep.insert_missing(old, new, "k").count() == 3 and upkeep.remove_items(old, new, "k").count() == 1


def test_stream_ingest_keeps_each_text_once(spark, tmp_path):
    source, corpus = str(tmp_path / "in"), str(tmp_path / "corpus")
    texts = [[(1, "One two."), (2, "one  two.")], [(3, "ONE TWO."), (4, "Three " * 20)]]
    for rows in texts:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest(feed, corpus, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(f"{corpus}/items").select("doc_id", "reason").collect()
    assert sorted((r.doc_id, r.reason) for r in got) == [(1, "too_short"), (4, None)]
