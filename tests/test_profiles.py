from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.scoring import categorical_subscore, numeric_subscore
from corpusloom.operators import activity, profiles
from corpusloom.streaming.spend import daily_spend


def test_numeric_subscore(spark):
    rows = [(5.0, 0.0, 10.0, 5.0, 100.0), (10.0, 0.0, 10.0, 5.0, 60.0), (20.0, 0.0, 10.0, 5.0, 20.0), (-20.0, 0.0, 10.0, 5.0, 0.0), (4.0, 4.0, 4.0, 4.0, 100.0), (4.5, 4.0, 4.0, 4.0, 100 - 40 * 0.5 / 0.6), (None, 0.0, 1.0, 0.5, None)]
    df = spark.createDataFrame(rows, "v double, lo double, hi double, m double, want double")
    got = df.select("want", numeric_subscore(F.col("v"), F.col("lo"), F.col("hi"), F.col("m")).alias("got")).collect()
    assert all((r.want is None and r.got is None) or abs(r.want - r.got) < 1e-9 for r in got)


def test_categorical_subscore(spark):
    df = spark.createDataFrame([(50.0, True, 60.0), (None, True, 20.0), (None, False, None)], "s double, r boolean, want double")
    assert df.where(~categorical_subscore(F.col("s"), F.col("r")).eqNullSafe(F.col("want"))).count() == 0


def test_null_keys_never_collapse(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", None), (4, "a", None)], "id long, owner string, hash string")
    assert sorted(r.id for r in profiles.dedup(df, "owner", "hash", "id").collect()) == [1, 3, 4]


def test_shares_similarity_and_drift(spark):
    df = spark.createDataFrame([("p", "a", "x"), ("p", "a", "y"), ("p", "a", "x"), ("q", "a", "x")], "source string, attribute string, value string")
    now = profiles.categorical_fingerprint(df, "source")
    assert all(abs(r.s - 100) < 1e-9 for r in now.groupBy("source").agg(F.sum("share").alias("s")).collect())
    assert all(r.distance == 0 for r in profiles.category_drift(now, now, "source").collect())
    num = spark.createDataFrame([("p", "n", 1.0), ("p", "n", 3.0), ("q", "n", 2.0)], "source string, attribute string, value double")
    prints = profiles.numeric_fingerprint(num, "source")
    assert profiles.similarity(prints, "source").first().similarity == 1.0
    assert all(r.delta == 0 for r in profiles.drift(prints, prints, "source").collect())


def test_hybrid_renormalises_weights(spark):
    prints = profiles.numeric_fingerprint(spark.createDataFrame([("p", "n", 4.0), ("q", "n", 8.0), ("p", "m", 5.0)], "source string, attribute string, value double"), "source")
    weights = spark.createDataFrame([("p", "h", 0.25), ("q", "h", 0.75)], "source string, hybrid string, weight double")
    assert {r.attribute: r["mean"] for r in profiles.blend(prints, weights, "source", "hybrid").collect()} == {"n": 7.0, "m": 5.0}


def test_shots_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(1, 1, 5.0, "B"), (1, 2, 15.0, "A"), (1, 3, None, "A"), (1, 4, 40.0, "B")], "i long, k int, s double, c string")
    r = activity.shot_attributes(df, "i", "k", "s", "c").first()
    assert (r.n_shots, r.main_category, r.median_s) == (4, "B", 15.0)


def test_median_is_withheld_below_half(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("a", None, 9.0)], "u string, x double, y double")
    r = activity.gated_median(df, "u", ["x", "y"]).first()
    assert (r.x, r.y, r.x_coverage) == (2.0, None, "2/3")


def test_gates(spark):
    df = spark.createDataFrame([(4000.0, "mind"), (3.0, "mind"), (None, "other"), (60.0, "mind games")], "s double, t string")
    reason = activity.first_reason(activity.length_gate(F.col("s")), activity.topic_gate(F.lit("x"), F.col("t"), ["mind"]))
    assert [r.r for r in df.select(reason.alias("r")).collect()] == ["too_long", "too_short", "off_topic", None]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(1700000000 + id * 5000) at, concat('s', id % 2) site, cast(id as double) cost from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = daily_spend(stream, "at", "site", "cost", 100).writeStream.format("memory").queryName("spend").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("spend").collect())) == sorted(map(tuple, daily_spend(rows, "at", "site", "cost", 100).collect()))
