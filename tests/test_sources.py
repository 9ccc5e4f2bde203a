from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.operators import profiles
from corpusloom.sources import readers
from corpusloom.streaming import refresh


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_transcripts_are_typed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Script,URL,Duration,PostedAt,ChapterCount\n"A, b"," x\ny ",http://u,61.5,2024-01-02,3\nC,nan,,,,\nD,  ,,,,\nE,text,,bad,never,0\n')
    got = {r.Title: r for r in readers.transcripts(spark, str(tmp_path / "a.csv"), "chan", "YouTube").collect()}
    assert set(got) == {"A, b", "E"} and got["A, b"].Script == "x\ny"
    assert (got["A, b"].duration_sec, got["A, b"].posted_at, got["A, b"].chapter_count, got["A, b"].has_chapters) == (61.5, datetime(2024, 1, 2), 3, 1)
    assert (got["E"].url, got["E"].duration_sec, got["E"].posted_at, got["E"].has_chapters, got["E"].channel) == (None, None, None, 0, "chan")


def test_cued_transcripts_come_once(spark, tmp_path):
    path = lines(tmp_path / "a.json", [{"title": "b", "script": " Same text! ", "cues": [{"start": 0.5, "text": "Same"}]}, {"title": "a", "script": "same  text"}, {"title": "c", "script": " "}])
    got = readers.cued_transcripts(spark, path).collect()
    assert [(r.title, r.cues, r.has_chapters) for r in got] == [("a", None, None)]


def test_shot_lists(spark, tmp_path):
    path = lines(tmp_path / "a.json", [{"url": "u", "title": "t", "duration_sec": 9.0, "shots": [{"shot_number": 1, "start_sec": 0.0, "end_sec": 4.0}, {"shot_number": 2, "start_sec": 4.0}, {"shot_number": 3, "start_sec": 6.0}]}, {"url": "v", "shots": [{"shot_number": 1, "start_sec": 0.0}]}])
    got = sorted((r.url, r.shot_number, r.end_sec, r.duration_sec) for r in readers.shot_lists(spark, path).where("end_sec is not null").collect())
    assert got == [("u", 1, 4.0, 4.0), ("u", 3, 9.0, 3.0)]
    assert readers.shot_lists(spark, path).count() == 4


def test_timelines_are_flat_and_unique(spark, tmp_path):
    one = {"url": "http://X/p/1", "account": "@me", "duration_sec": 3.0, "editing": {"n_cuts": 2, "cut_times": [1.0, 2.0]}, "movement": {"mean": 0.5, "series": [1.0]}, "sound": {"pauses": [[0.1, 0.2]]}, "picture": {"mean_luma": 99.0}}
    path = lines(tmp_path / "a.json", [one, one, {"url": " "}, {"title": "no link"}])
    (r,) = readers.timelines(spark, path).collect()
    assert (r.account, r.n_cuts, r.cut_times, r.motion_mean, r.motion_series, r.pauses, r.mean_luma, r.est_bpm) == ("me", 2.0, [1.0, 2.0], 0.5, [1.0], [[0.1, 0.2]], 99.0, None)


def test_format_inputs_and_pages(spark, tmp_path):
    path = lines(tmp_path / "a.json", [{"url": "u", "account": "a", "frames": [{"at_sec": 1.0, "note": "x"}, {"at_sec": 2.0}]}, {"url": "v"}, {"account": "none"}])
    got = sorted((r.url, r.frame if r.frame is not None else -1, r.at_sec) for r in readers.format_inputs(spark, path).collect())
    assert got == [("u", 0, 1.0), ("u", 1, 2.0), ("v", -1, None)]
    pages = readers.book_pages(spark, lines(tmp_path / "p.json", [{"book": "b", "page_num": 2}])).collect()
    assert [tuple(p) for p in pages] == [("b", 2, "", False)]


def test_books_subtitles_manifests_and_logs(spark, tmp_path):
    (tmp_path / "book.txt").write_text("one  two\n\nthree ")
    assert [(r.word_count, r.status) for r in readers.books(spark, str(tmp_path / "book.txt")).collect()] == [(3, "pending")]
    subs = tmp_path / "subs"
    subs.mkdir()
    (subs / "Ab_1.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> there\n\n2\n00:01:00,000 --> 00:01:03,250\nBye {x}now\n")
    (subs / "zz.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nHi\n")
    (tmp_path / "m.json").write_text(json.dumps([{"url": "https://x/reel/Ab_1/", "title": "t"}, {"url": "https://x/shorts/zz?a=1"}, {"url": "https://x/p/none/"}, {"url": "https://x/"}]))
    got = {r.url: r for r in readers.subtitle_manifests(spark, str(tmp_path / "m.json"), str(subs)).collect()}
    assert (got["https://x/reel/Ab_1/"].text, got["https://x/reel/Ab_1/"].last_end) == ("Hello there\n\nBye now", 63.25)
    assert got["https://x/shorts/zz?a=1"].last_end == 2.0 and got["https://x/p/none/"].text is None and len(got) == 4
    (tmp_path / "log.jsonl").write_text('{"ts": 0.0, "model": "m", "input_tokens": 5}\nnot json\n')
    assert [(r.model, r.input_tokens) for r in readers.usage_log(spark, str(tmp_path / "log.jsonl")).collect()] == [("m", 5)]


def test_a_stream_rebuilds_touched_profiles_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0)], "id long, account string, value double")
    build = lambda items: profiles.numeric_fingerprint(profiles.long_numeric(items, ["account"], ["value"]), "account")
    path = str(tmp_path / "store")
    assert refresh.profiles(spark, path) is None
    refresh.refresh_batch(rows, 0, path, "account", build)
    more = spark.createDataFrame([(3, "a", 3.0), (4, None, 9.0)], "id long, account string, value double")
    for _ in range(2):  # a batch that comes again changes nothing
        refresh.refresh_batch(more, 1, path, "account", build)
    got = {r.account: (r.n, r["mean"]) for r in refresh.profiles(spark, path).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 5.0)}
    (tmp_path / "feed").mkdir()
    more.where("account = 'a'").withColumn("account", F.lit("c")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(more.schema).parquet(str(tmp_path / "feed"))
    refresh.refresh(feed, str(tmp_path / "other"), str(tmp_path / "check"), "account", build).awaitTermination(60)
    assert [(r.account, r.n) for r in refresh.profiles(spark, str(tmp_path / "other")).collect()] == [("c", 1)]
