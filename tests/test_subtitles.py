from __future__ import annotations

from corpusloom.sources import readers
from corpusloom.streaming import subtitles

ONE = "1\n00:00:01,000 --> 00:00:02,500\n 2 <i>Hello</i> there \n{x}\nagain{}\n\n  \n2\n00:01:00,000 --> 00:01:03,250\nBye {x}now\n12\n"
TWO = "WEBVTT\r\n\r\n00:01.000 --> 00:02.000\r\nHi 0\r\nyou 1\r\n\r\nwebvtt\r\nWEBVTT more\r\n"


def test_text_of_subtitles(spark):
    rows = spark.createDataFrame([(0, ONE), (1, TWO), (2, ""), (3, "\n \n"), (4, None), (5, "5\n-->\n<b></b>")], "i int, raw string")
    got = {r.i: r.t for r in rows.select("i", readers.subtitle_text(rows.raw).alias("t")).collect()}
    assert got == {0: "2 Hello there again\n\nBye now", 1: "Hi 0 you 1\n\nWEBVTT more", 2: "", 3: "", 4: "", 5: ""}


def test_batch_and_stream_give_the_same_rows(spark, tmp_path):
    subs, store, check = tmp_path / "subs", str(tmp_path / "store"), str(tmp_path / "check")
    (subs / "b").mkdir(parents=True)
    (subs / "Ab_1.srt").write_text(ONE)
    (subs / "b" / "zz.en.vtt").write_text(TWO)
    (subs / "b" / "broken.SRT").write_bytes(b"1\n00:00:01,000 --> 00:00:09,000\nca\xff\xfef\xc3\xa9\n")
    (subs / "b" / "empty.vtt").write_text("")  # no row
    (subs / "b" / "no.vtt").write_text("WEBVTT\n")
    (subs / "b" / "notes.txt").write_text("no subtitles")
    told = lambda rows: sorted((r.path.split("/subs/")[1], r.shortcode, r.text, r.last_cue, r.status) for r in rows.collect())
    subtitles.follow(spark, str(subs), store, check, 2).awaitTermination(60)
    want = told(readers.subtitles(spark, str(subs)))
    assert told(subtitles.files(spark, store)) == want and [r[4] for r in want] == ["ok", "bad_bytes", "no_text", "ok"]
    assert want[1] == ("b/broken.SRT", "broken", "café", "00:00:09,000", "bad_bytes")
    # a file that comes later, in a folder of its own and under a known code; the others are not read again
    (subs / "c").mkdir()
    (subs / "c" / "zz.de.vtt").write_text("WEBVTT\n\n00:01.000 --> 01:02.500\nHallo\n")
    subtitles.follow(spark, str(subs), store, check, 2).awaitTermination(60)
    subtitles.follow(spark, str(subs), store, check, 2).awaitTermination(60)
    rows = subtitles.files(spark, store)
    assert told(rows) == told(readers.subtitles(spark, str(subs))) and rows.count() == 5
    assert {r.shortcode: r.duration_sec for r in subtitles.durations(rows).collect()} == {"Ab_1": 63.25, "zz": 62.5, "broken": 9.0}
