from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import titles
from corpusloom.operators import cards, matching, replies, scoring, upkeep


def test_suggestions(spark):
    accounts = spark.createDataFrame([("Kyla Scan",), ("kyla.scanlon",), ("other",)], "account string")
    names = spark.createDataFrame([("kylascan",), ("other",), ("zzzz",)], "name string")
    rows = matching.suggestions(names, accounts, "name", "account").collect()
    got = {(r.name, r.place): (r.account, r.confidence, r.action) for r in rows}
    assert got["kylascan", 1] == ("Kyla Scan", 1.0, "confirm_existing") and got["kylascan", 2][0] == "kyla.scanlon"
    assert got["other", 1] == ("other", 1.0, "proceed") and got["zzzz", 0] == (None, None, "confirm_new")


def test_subjects_of_domains(spark):
    domains = {"Behavioural Economics": "Economics", "geopolitics": "Politics", "AI safety": "Technology", "Mountain air": None, "self-help": "Psychology", "": None, None: None, "climate science": "Science"}
    rows = spark.createDataFrame([(d,) for d in domains], "d string").select("d", matching.subject_of(F.col("d")).alias("s")).collect()
    assert {r.d: r.s for r in rows} == domains


def test_candidate_sources(spark):
    rows = [(1, '[{"account": "a"}, {"account": "b"}, {"account": "a"}]', "z"), (2, None, "z"), (3, "[]", None), (4, "broken", "y")]
    got = sorted(map(tuple, matching.candidate_sources(spark.createDataFrame(rows, "k long, many string, one string"), "k", "many", "one").collect()))
    assert got == [(1, "a"), (1, "b"), (2, "z"), (4, "y")]


def test_members_override_scores_and_breakdowns(spark):
    scores = spark.createDataFrame([(1, "p", 40.0, {"x": 40.0}), (1, "q", 50.0, {"x": 50.0}), (2, "p", None, {"x": 1.0})], "item long, profile string, score double, breakdown map<string,double>")
    members = spark.createDataFrame([(1, "p", "exact", 1.0), (2, "p", "near", 0.9)], "item long, profile string, match string, similarity double")
    got = sorted((r.item, r.profile, r.score, r.breakdown) for r in scoring.with_members(scores, members, "item", "profile").collect())
    assert got == [(1, "p", 100.0, None), (1, "q", 50.0, {"x": 50.0}), (2, "p", 98.5, None)]


def test_pairs_in_blocks_are_all_pairs_once(spark):
    items, profiles = spark.range(50).select(F.col("id").alias("i")), spark.range(21).select(F.col("id").alias("p"))
    rows = scoring.pairs_in_blocks(items, profiles, "i", "p", 4).collect()
    assert len(rows) == len({(r.i, r.p) for r in rows}) == 1050


def test_confirmed_profiles_or_all(spark):
    rows = spark.createDataFrame([("a", "Video", "draft"), ("b", "ProductionSpec", "confirmed"), ("c", None, "draft")], "p string, media string, status string")
    assert sorted(r.p for r in scoring.comparable(rows).collect()) == ["a", "c"]
    assert [r.p for r in scoring.comparable(rows.union(spark.createDataFrame([("d", "Book", "confirmed")], rows.schema))).collect()] == ["d"]


def test_odd_replies(spark):
    texts = ["```json\n{\"a\": \"1\", \"b\": {\"c\": 2}}\n```", "[1, 2]", "[]", None, "{broken", "x ```[{\"a\": null}]``` y"]
    rows = replies.parsed_replies(spark.createDataFrame(list(enumerate(texts)), "k long, reply string"), "k", "reply", ["a", "b"]).orderBy("k").collect()
    assert [(r.n_objects, r.valid) for r in rows] == [(1, True), (0, False), (0, False), (0, False), (0, False), (1, True)]
    assert rows[0]["items"] == [{"a": "1", "b": '{"c":2}'}] and rows[5]["items"] == [{"a": None}]


def test_visuals_without_a_time_are_dropped(spark):
    old = spark.createDataFrame([(1, "00:01", 1), (2, "00:09", 9)], "item long, marker string, seconds long")
    new = spark.createDataFrame([(1, "1:02"), (1, "soon"), (1, "01:00:01")], "item long, marker string")
    got = sorted(map(tuple, upkeep.replace_visuals(old, new, "item", "marker").collect()))
    assert got == [(1, "01:00:01", 3601), (1, "1:02", 62), (2, "00:09", 9)]


def test_labels_of_numbers_and_times(spark):
    frame = spark.createDataFrame([(7.0,), (1234.0,), (2_000_000.0,), (3661.0,)], "n double")
    got = frame.select(titles.number_label(F.col("n")).alias("a"), titles.stamp_of(F.col("n")).alias("b")).collect()
    assert [r.a for r in got] == ["7", "1.2k", "2M", "3.7k"] and [r.b for r in got] == ["00:07", "20:34", "555:33:20", "1:01:01"]
    stamps = spark.createDataFrame([("00:01:03,250",), ("01:02.5",), ("x",), (None,)], "s string").select(titles.cue_seconds(F.col("s")).alias("c")).collect()
    assert [r.c for r in stamps] == [63.25, 62.5, None, None]


def test_cards_without_data(spark):
    row = spark.createDataFrame([(12.34, None, None)], "m double, cv double, r double")
    (got,) = row.select(cards.sentence_rhythm(F.col("m"), F.col("cv")).alias("a"), cards.paragraph_shape(F.col("r"), F.col("m")).alias("b")).collect()
    assert got.a == "~12.3 words/sentence on average." and got.b is None


def test_pairs_of_few_bytes_are_spread_over_tasks(spark):
    """By their bytes alone, all pairs of small items would stand in one or two tasks."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items, profiles = spark.range(2000).select(F.col("id").alias("i")), spark.range(20).select(F.col("id").alias("p"))
    rows = scoring.pairs_in_blocks(items, profiles, "i", "p").groupBy(F.spark_partition_id().alias("t")).agg(F.countDistinct("i").alias("n")).collect()
    assert len(rows) > parts and max(r.n for r in rows) < 2000 * 4 / parts
