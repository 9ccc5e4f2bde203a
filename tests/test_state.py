from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators.profiles import long_numeric, numeric_fingerprint
from corpusloom.streaming import state


def delivered(frame, folder, name):
    """One file of a feed, as if it came now."""
    import shutil

    out = folder / f"_{name}"
    frame.coalesce(1).write.parquet(str(out))
    (part,) = out.glob("part-*.parquet")
    shutil.move(part, folder / f"{name}.parquet")


def test_texts_come_in_once(spark, tmp_path):
    feed_dir, schema = tmp_path / "feed", "doc_id long, text string"
    feed_dir.mkdir()
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed_dir))
    say = "many words stand here " * 9
    one = spark.createDataFrame([(7, say + "one"), (3, say.upper() + "ONE!"), (5, say + "two"), (9, None), (8, ""), (None, say + "lost")], schema)
    late = spark.createDataFrame([(1, say + "one"), (2, say + "three")], schema)

    def run():
        q = state.ingest_once(feed(), str(tmp_path / "corpus"), str(tmp_path / "check"))
        q.awaitTermination(120)
        return q

    delivered(one, feed_dir, "a")
    run()
    kept = lambda: sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "corpus")).collect())
    assert kept() == [3, 5, 8]
    delivered(one, feed_dir, "b")  # the same rows in another file
    q = run()
    assert kept() == [3, 5, 8]
    told = q.lastProgress["stateOperators"][0]
    assert told["numRowsTotal"] == 3 and told["numRowsUpdated"] == 0
    delivered(late, feed_dir, "c")  # an older id that comes later
    q = run()
    assert kept() == [2, 3, 5, 8]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 4
    rows = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "corpus")).collect()}
    assert rows[5].word_count == 37 and rows[8].reason is not None


def test_profiles_follow_edits_moves_and_removals(spark, tmp_path):
    draw = random.Random(2)
    feed_dir, path = tmp_path / "feed", str(tmp_path / "store")
    feed_dir.mkdir()
    schema = "item long, seq long, account string, removed boolean, size double, pace double"
    now, seq = {}, 0
    for batch in range(4):
        rows = []
        for _ in range(120):
            seq += 1
            i = draw.randrange(60)
            row = (i, seq, draw.choice(["a", "b", "c", None]) if batch < 3 else "a", draw.random() < 0.15, draw.choice([None, 1.0, 2.5, 7.0]), draw.random())
            rows.append(row)
            now[i] = row
        if batch == 2:
            rows.append((0, 1, "zzz", False, 1.0, 1.0))  # an old row that comes late
        draw.shuffle(rows)
        delivered(spark.createDataFrame(rows, schema), feed_dir, f"f{batch}")
        feed = spark.readStream.schema(schema).parquet(str(feed_dir))
        state.follow(feed, path, str(tmp_path / "check"), "item", "account", ["size", "pace"]).awaitTermination(120)
        there = spark.createDataFrame([r for r in now.values() if not r[3] and r[2] is not None], schema)
        want = numeric_fingerprint(long_numeric(there, ["account"], ["size", "pace"]), "account")
        shown = lambda d: sorted((r.account, r.attribute, r.n, *(round(r[c], 9) for c in ("mean", "std", "low", "high", "median"))) for r in d.collect())
        assert shown(state.profiles(spark, path)) == shown(want), batch


def test_a_batch_reads_its_buckets_alone_and_may_come_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "account string, attribute string, value double, sign int")
    state.merge_counts(frame([(f"a{i}", "x", 1.0, 1) for i in range(200)]), 0, path)
    assert len(state._versions(spark, path)) == len({r.b for r in spark.range(200).select(F.pmod(F.xxhash64(F.concat(F.lit("a"), F.col("id").cast("string"))), F.lit(state.BUCKETS)).alias("b")).collect()})
    opened, plain = [], state._counts
    monkeypatch.setattr(state, "_counts", lambda spark, path, versions: opened.append(len(versions)) or plain(spark, path, versions))
    more = frame([("a7", "x", 1.0, -1), ("a7", "x", 3.0, 1)])
    for _ in range(2):
        state.merge_counts(more, 1, path)
    assert opened == [1, 1]
    state.merge_counts(frame([]), 2, path)
    got = {r.account: (r.n, r["mean"]) for r in state.profiles(spark, path).collect()}
    assert len(got) == 200 and got["a7"] == (1, 3.0) and got["a8"] == (1, 1.0)
    state.merge_counts(frame([("a7", "x", 3.0, -1)]), 3, path)
    assert state.profiles(spark, path).where("account = 'a7'").collect() == []
