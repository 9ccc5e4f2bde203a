from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.operators import matching, profiles, ranking, replies, scoring, upkeep
from corpusloom.sources.staging import RunStore


def told(name, accounts, k=5):
    norm = lambda t: "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    x, rows = norm(name), []
    for a in set(accounts):
        y = norm(a)
        rows.append((-(1.0 if x == y else SequenceMatcher(None, x, y).ratio()), a))
    return [(a, round(-s, 3)) for s, a in sorted(rows)[:k] if -s >= 0.5]


def test_suggestions_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    parts = ["ky", "la", "scan", "lon", "talk", "money", "the", "daily", "dr", "news", "7", "x", "zz", "o", "an"]
    draw = lambda: " ".join(rng.choice(parts, int(rng.integers(1, 5)))).title()
    accounts = [*{draw() for _ in range(300)}, "Kyla Scan", "kyla.scan", "KYLA-SCAN", "kylascan", "kylascan!", "kyla scan?", "kyla_scan", "", "--", "q", "aaaa"]
    names = [*{draw() for _ in range(150)}, "kylascan", "Kyla Scan", "", "zzzzzz", "q", "ab", "aaaab"]
    frame = spark.createDataFrame([(a, len(a)) for a in accounts], "account string, size int")
    out = matching.suggestions(spark.createDataFrame([(n,) for n in names], "name string"), frame, "name", "account", told=["size"])
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.name, []).append((r.place, r.account, r.confidence))
        assert r.size == (None if r.account is None else len(r.account))
    for n in names:
        want = told(n, accounts)
        assert [x[1:] for x in sorted(got[n])] == (want or [(None, None)]), n


def test_chains_of_merges(spark):
    n = 1000
    rows = [(f"a{i}", f"a{i + 1}") for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("p", "q"), ("p", "r"), (None, "a1"), ("b", None)]
    got = {r.source: (r.into, r.status) for r in upkeep.settled_merges(spark.createDataFrame(rows, "source string, into string"), "source").collect()}
    want = {f"a{i}": (f"a{n}", "merged") for i in range(n)} | dict.fromkeys("xyz", (None, "cycle")) | {"p": ("q", "merged")}
    assert got == want
    none = spark.createDataFrame([], "source string, into string")
    assert upkeep.settled_merges(none, "source").collect() == []


def test_all_tables_follow_a_chain(spark):
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("l", "m"), ("m", "l")], "source string, into string")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    prints = frame([("a", "Video", 1), ("b", "Book", 2), ("c", "Video", 3), ("l", "Video", 4)], "source string, media string, n int")
    out = upkeep.merge_everywhere(mapping, "source", "media", prints, {"items": frame([(1, "a"), (2, "b"), (3, "c"), (4, "l"), (5, None)], "item int, source string")}, {"drafts": frame([(1, "a"), (2, "nobody"), (3, None)], "draft int, source string")})
    rows = {name: sorted(map(tuple, t.collect()), key=str) for name, t in out.items()}
    assert rows["items"] == [(1, "c"), (2, "c"), (3, "c"), (4, "l"), (5, None)] or {tuple(r[c] for c in ("item", "source")) for r in out["items"].collect()} == {(1, "c"), (2, "c"), (3, "c"), (4, "l"), (5, None)}
    assert rows["profiles"] == [("c", "Book", 2), ("c", "Video", 3), ("l", "Video", 4)]
    assert rows["drafts"] == [(1, "c"), (2, None), (3, None)]


def test_runs_are_stored_once(spark, tmp_path):
    store, one = RunStore(spark, f"file://{tmp_path}/runs"), spark.createDataFrame([(1, "p", 2.0)], "item int, profile string, score double")
    assert store.read("scores") is None and store.runs() is None
    assert store.commit("r1", {"scores": one}) and not store.commit("r1", {"scores": one.union(one)})
    one.union(one).write.parquet(f"{tmp_path}/runs/tables/scores/run_id=r2")  # a commit that broke before its marker
    (tmp_path / "runs/tables/scores/run_id=r3").mkdir()
    (tmp_path / "runs/tables/scores/run_id=r3/part-0.parquet").write_bytes(b"half")
    again = RunStore(spark, f"file://{tmp_path}/runs")  # a new driver
    assert [tuple(r) for r in again.read("scores").collect()] == [(1, "p", 2.0, "r1")]
    assert again.commit("r2", {"scores": one}) and not again.commit("r1", {"scores": one})
    assert sorted(r.run_id for r in again.read("scores").collect()) == ["r1", "r2"] == sorted(r.run_id for r in again.runs().collect())
    with pytest.raises(ValueError, match="run id"):
        store.commit("a/b", {})


def test_coverage_by_kind(spark):
    rows = spark.createDataFrame([(1, "en", True, 0), (3, None, False, 1), (None, "en", None, 1)], "n int, lang string, seen boolean, toxic int")
    got = {r.attribute: (r.kind, r.filled, r.low, r.high, r.mean, r.n_values, r.n_true, r.n_false) for r in profiles.coverage(rows, ["n", "lang", "seen", "toxic"], ("toxic",)).collect()}
    assert got == {"n": ("number", 2, 1.0, 3.0, 2.0, 2, None, None), "lang": ("text", 2, None, None, None, 1, None, None), "seen": ("flag", 2, None, None, None, 2, 1, 1), "toxic": ("flag", 3, None, None, None, 2, 2, 1)}


def test_shares_drift_and_macros_are_rounded(spark):
    values = spark.createDataFrame([("p", "lang", v) for v in ("en", "en", "de")], "source string, attribute string, value string")
    assert {r.value: r.share for r in profiles.categorical_fingerprint(values, "source").collect()} == {"en": 66.7, "de": 33.3}
    mean = lambda m: spark.createDataFrame([("p", "x", m), ("p", "zero", m - 3.0)], "source string, attribute string, mean double")
    got = {r.attribute: (r.delta, r.percent) for r in profiles.drift(mean(3.12345), mean(3.0), "source").collect()}
    assert got == {"x": (0.123, 4.1), "zero": (0.123, None)}
    scores = spark.createDataFrame([(1, "p", {"a": 60.0, "b": 65.5, "odd": 10.0}), (2, "p", None)], "item int, profile string, breakdown map<string,double>")
    fit = {r.macro: (r.fit, r.fields) for r in scoring.macro_fit(scores, "item", "profile", {"form": ["a", "b"]}).collect()}
    assert fit == {"form": (62.8, 2), "Other": (10.0, 1)}


def test_format_inputs_and_profiles(spark):
    readings = replies.axis_readings(spark.createDataFrame([(1, "v", "x"), (2, "v", "y"), (3, "v", "y"), (4, "v", "x"), (5, "v", "bad"), (6, "v", "x")], "k int, axis string, value string"), "k", "axis", "value", {"v": ["x", "y"]})
    inputs = spark.createDataFrame([(1, " SAME ", "editorial"), (2, "maybe", "Editorial"), (3, "differs", None), (4, None, "promotional"), (5, "same", "editorial"), (6, "no_audio", "ad")], "k int, r string, s string")
    read = replies.read_inputs(inputs, "k", "r", "s", readings)
    got = {r.k: (r.text_audio_relation, r.segment_kind, r.excluded, r.axes, r.status) for r in read.collect()}
    assert got == {1: ("same", "editorial", 0, 1, "classified"), 2: (None, "editorial", 0, 1, "classified"), 3: ("differs", None, 0, 1, "classified"), 4: (None, "promotional", 1, 1, "classified"), 5: ("same", "editorial", 0, 0, "needs_review"), 6: ("no_audio", None, 0, 1, "classified")}
    rows = replies.format_profiles(readings, read.withColumn("account", F.lit("a")), "k", "account", "axis", "value").collect()
    assert [tuple(r) for r in rows] == [("a", "v", "x", 2, 4, 4, "confirmed")]


def test_running_sums_and_medians_of_a_hot_key(spark):
    rng = np.random.default_rng(5)
    values = [("hot", float(v)) for v in rng.integers(0, 400, 3001)] + [("hot", None), (None, 4.0), (None, 9.0), ("one", 1.5)]
    rows = spark.createDataFrame(values, "k string, v double")
    got = {r.k: (r.n, r.median) for r in ranking.medians(rows, ["k"], "v").collect()}
    assert got == {"hot": (3001, float(np.median([v for k, v in values if k == "hot" and v is not None]))), None: (2, 6.5), "one": (1, 1.5)}
    placed = ranking.running_before(rows.where("k = 'hot' and v is not null").select("v").distinct().withColumn("k", F.lit("x")), ["k"], ["v"], F.lit(1), "at").orderBy("v").collect()
    assert [r.at for r in placed] == list(range(len(placed)))
    assert ranking.medians(rows.where("v < 0"), ["k"], "v").collect() == []


def test_no_job_before_an_action(spark, monkeypatch):
    reads, tracker = [], spark.sparkContext.statusTracker()
    plain = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: reads.append(paths) or plain(self, *paths, **options))
    for name in ("profile_similarity", "rank_profiles", "complete_scores"):
        reads.clear()
        spark.sparkContext.setJobGroup(name, name)
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(tracker.getJobIdsForGroup(name)) <= len(reads), name  # one for the schema of each table read
    spark.sparkContext.setJobGroup("after", "after")
