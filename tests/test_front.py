from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import activity, cards, library, profiles, rosters, scoring, upkeep, views


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def test_hot_fingerprint_is_the_fingerprint(spark):
    rng = random.Random(3)
    rows = [("hot", a, rng.choice([1.5, -2.0, rng.random() * 1e6])) for a in "xy" for _ in range(3000)]
    rows += [(None, "x", 1.0), (None, "x", 4.0), ("one", "x", 7.0), ("one", "y", None), ("none", "x", None)]
    long = spark.createDataFrame(rows, "p string, attribute string, value double").repartition(7)
    key = lambda r: (r.p is None, r.p, r.attribute)
    got = {key(r): r for r in profiles.hot_fingerprint(long, "p").collect()}
    want = {key(r): r for r in profiles.numeric_fingerprint(long.where("value is not null"), "p").collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert all(same(got[k][c], r[c]) for c in ("n", "mean", "std", "low", "high", "median")), k
    assert got[(False, "hot", "x")].median == statistics.median(v for p, a, v in rows if p == "hot" and a == "x")
    assert profiles.hot_fingerprint(long.where("p = 'gone'"), "p").collect() == []


def test_hot_gated_median_is_the_gated_median(spark):
    rng = random.Random(4)
    rows = [("hot", rng.random(), rng.choice([None, 2.0, 3.0]), rng.choice([None, None, None, 1.0])) for _ in range(4000)]
    rows += [(None, 1.0, None, None), (None, 2.0, 5.0, None), ("bare", None, None, None)]
    table = spark.createDataFrame(rows, "a string, x double, y double, z double").repartition(5)
    by = lambda d: {r.a: r.asDict() for r in d.collect()}
    got, want = by(activity.hot_gated_median(table, "a", ["x", "y", "z"])), by(activity.gated_median(table, "a", ["x", "y", "z"]))
    assert got == want and got["hot"]["z"] is None and got["bare"]["x_coverage"] == "0/1"


VIDEO = "item int, title string, account string, subject string, profile_subject string, words int, media string, title_format string, duration int, added int"
VIDEOS = [(1, "beta 1", "A", "art", "law", 10, "Instagram", "list", 5, 1), (2, "Alpha", "B", "art", None, None, "YouTube", None, None, 3), (3, None, "A", None, None, 30, None, "list", 9, 3), (4, "alpha 2", "B", "odd", None, 20, "Instagram", "how", 7, None)]
BOOK = "item int, title string, account string, subject string, profile_subject string, words int, added int"
BOOKS = [(1, "Gamma", "A", "art", "law", 500, 2), (2, "alphabet", "C", None, "law", None, 9)]


@pytest.fixture()
def shelf(spark):
    tags = lambda *rows: spark.createDataFrame(rows, "item int, tag string")
    return spark.createDataFrame(VIDEOS, VIDEO), spark.createDataFrame(BOOKS, BOOK), ["art", "law"], (tags((1, "Sun"), (1, "SUN"), (4, None)), tags((2, "sun"))), (tags((3, "Case")), tags((1, "x")))


def test_filters_and_orders_of_the_library(shelf):
    ids = lambda **asked: [f"{r.kind[0]}{r.item}" for r in library.library_items(*shelf, **asked).collect()]
    assert ids() == ids(order="odd") == ["b2", "v2", "v3", "b1", "v1", "v4"]
    assert ids(up=True) == ["v4", "v1", "b1", "v2", "v3", "b2"]
    assert ids(order="title", up=True) == ["v3", "v2", "v4", "b2", "v1", "b1"] and ids(order="words") == ["b1", "v3", "v4", "v1", "b2", "v2"]
    assert ids(order="duration") == ["v3", "v4", "v1", "b1", "b2", "v2"]
    assert ids(kind="book") == ["b2", "b1"] and ids(kind="youtube") == ["v2"] and ids(kind="video") == ["v1", "v4"]
    assert ids(account="A") == ["v3", "b1", "v1"] and ids(text="ALPHA") == ["b2", "v2", "v4"]
    assert ids(title_format="list") == ["v3", "v1"] and ids(kind="book", title_format="list") == []
    assert ids(least=20) == ["v3", "b1", "v4"] and ids(least=10, most=20) == ["v1", "v4"]
    assert ids(term="sun") == ["b2", "v1"] and ids(example="CASE") == ["v3"] and ids(term="sun", example="case") == []
    # a video's subject is its profile's first, a book's its own
    assert ids(subject="law") == ["b2", "v1"] and ids(subject="art") == ["v2", "b1"]
    assert ids(subject="Unassigned") == ["v3", "v4"] and ids(subject="nothing") == ids()
    assert library.library_items(*shelf).where("kind = 'video' and item = 4").first().subject is None
    assert library.library_items(*shelf).where("kind = 'video' and item = 3").first().media == "Instagram"


def test_an_empty_library_and_missing_tags(shelf):
    videos, books, subjects, *_ = shelf
    assert library.library_items(videos.limit(0), books.limit(0), subjects, text="a").collect() == []
    with pytest.raises(ValueError, match="terms"):
        library.library_items(videos, books, subjects, term="sun")


def test_moved_items_rebuild_their_accounts_alone(spark):
    items = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, "c", 9.0), (5, None, 2.0)], "i int, acc string, v double")
    moves = spark.createDataFrame([(2, "b"), (2, "d"), (4, "b"), (5, "d"), (1, None), (99, "a"), (3, "b")], "i int, acc string")
    seen = []

    def build(rows):
        seen.append(rows)
        return profiles.numeric_fingerprint(profiles.long_numeric(rows, ["acc"], ["v"]), "acc").select("acc", "n", "mean")

    prints = build(items.where("acc is not null")).union(spark.createDataFrame([("z", 7, 7.0)], "acc string, n long, mean double"))
    done = library.reassign_and_rebuild(items, moves, prints, "i", "acc", build)
    assert {r.i: r.acc for r in done["items"].collect()} == {1: "a", 2: "b", 3: "b", 4: "b", 5: "d"}
    assert {r.acc for r in done["accounts"].collect()} == {"a", "b", "c", "d"}
    assert {tuple(r) for r in done["prints"].collect()} == {("a", 1, 1.0), ("b", 3, 17 / 3), ("d", 1, 2.0), ("z", 7, 7.0)}
    nothing = library.reassign_and_rebuild(items, moves.limit(0), prints, "i", "acc", build)
    assert nothing["accounts"].collect() == [] and sorted(nothing["prints"].collect()) == sorted(prints.collect())


def test_media_are_corrected_as_reported(spark):
    rows = spark.createDataFrame([(1, "https://www.instagram.com/p/1", "YouTube"), (2, "https://youtu.be/x", "YouTube"), (3, "https://else.net", "YouTube"), (4, None, "Instagram"), (5, "https://youtu.be/y", None)], "i int, url string, media string")
    right = F.nullif(T.platform(F.col("url"), ""), F.lit(""))
    told = {r.i: r.new for r in upkeep.repaired_media(rows, "i", "media", right).collect()}
    assert told == {1: "Instagram"}
    after = library.corrected_media(rows, "media", right)
    assert {r.i: r.media for r in after.collect()} == {1: "Instagram", 2: "YouTube", 3: "YouTube", 4: "Instagram", 5: None}
    assert upkeep.repaired_media(after, "i", "media", right).collect() == []  # applied twice, it changes nothing


def test_usable_inputs(spark):
    inputs = spark.createDataFrame([(1, "classified"), (2, "pending"), (3, "pending"), (4, None), (5, "needs_review")], "i int, status string")
    shots = spark.createDataFrame([(1, None), (2, 1), (2, 0), (3, 1), (5, None), (9, 0)], "i int, got int")
    assert sorted(r.i for r in rosters.usable_inputs(inputs, shots, "i", "status", "got").collect()) == [1, 3, 4]


SECTION = "id int, name string, url string, title string, at string, classified boolean"


def test_roster(spark):
    d = lambda *rows: spark.createDataFrame(list(rows), SECTION)
    sections = {
        "library": d((1, "Ann Lee", "http://i/1?x=2", "", "2024", True), (2, "ann.lee", "http://I/1/", "First", "2023", False), (3, "Bob", None, "t", "2025", True), (4, None, "", None, None, None)),
        "production": d((9, "@annlee", "HTTP://i/1", "Later", "2026", None), (8, "annlee", "http://i/2", None, None, True)),
        "format": d((5, "Cy", "http://i/1", None, "2020", True)),
    }
    videos = rosters.roster_videos(sections)
    got = {(r.key, r.url): r for r in videos.collect()}
    assert set(got) == {("annlee", "http://i/1?x=2"), ("annlee", "http://i/2"), ("cy", "http://i/1")}
    one = got["annlee", "http://i/1?x=2"]
    assert (one.title, one["at"], one.library_id, one.library_classified, one.production_id, one.production_classified, one.format_id, one.format_classified) == ("First", "2026", 2, False, 9, False, None, None)
    codes = {"format": spark.createDataFrame([("new one", "F.3"), ("C.Y", "F.2"), ("cy", "F.1")], "name string, code string"), "library": spark.createDataFrame([("ANNLEE", "A.1"), ("nobody", "A.2")], "name string, code string")}
    rows = {r.key: r for r in rosters.roster_accounts(sections, videos, ("format", "library", "production"), codes).collect()}
    assert set(rows) == {"annlee", "bob", "cy", "newone", ""}
    ann = rows["annlee"]
    assert (ann.display, ann.library_name, ann.production_name, ann.library_code, ann.videos, ann.library_stored, ann.library_classified, ann.production_stored, ann.production_classified) == ("@Ann Lee", "Ann Lee", "annlee", "A.1", 2, 1, 0, 2, 1)
    assert (rows["cy"].display, rows["cy"].format_code, rows["newone"].display, rows["newone"].videos, rows[""].display) == ("@Cy", "F.1", "@new one", 0, "@")
    empty = {s: t.limit(0) for s, t in sections.items()}
    none = rosters.roster_videos(empty)
    assert none.collect() == [] and rosters.roster_accounts(empty, none, ("format", "library", "production")).collect() == []


def test_stories(spark):
    scripts = spark.createDataFrame([(1, "One", "Ann", "5"), (2, None, None, None), (3, "", "Bob", "9")], "script int, title string, account string, at string")
    specs = spark.createDataFrame([(10, 1, "old", "P", "1"), (11, 1, "new", "P", "2"), (12, None, "loose", "Q", "3"), (13, 77, "lost", "Q", None)], "spec int, script int, title string, account string, at string")
    videos = spark.createDataFrame([(20, 11, "a", "1"), (21, 11, "b", "2"), (22, 10, "c", "3"), (23, None, None, "4"), (24, 99, "d", None)], "video int, spec int, title string, at string")
    rows = rosters.stories(scripts, specs, videos)
    got = {(r.script, r.spec, r.video): (r.title, r.stage) for r in rows.collect()}
    assert got == {(1, 11, 21): ("One", "video"), (2, None, None): ("Script #2", "script"), (3, None, None): ("Script #3", "script"), (None, 10, 22): ("old", "video"), (None, 12, None): ("loose", "shots"), (None, 13, None): ("lost", "shots"), (None, None, 20): ("a", "video"), (None, None, 23): ("Video #23", "video"), (None, None, 24): ("d", "video")}
    assert rosters.stage_counts(rows).first().asDict() == {"script": 2, "shots": 2, "video": 5, "all": 9}
    titles = lambda **asked: [r.title for r in rosters.story_list(rows, **asked).collect()]
    assert titles(stage="script") == ["Script #3", "Script #2"] and titles(stage="shots") == ["loose", "lost"] and titles(text="ANN") == ["One"]
    assert titles(stage="any") == titles() and titles()[0] == "Script #3" and len(titles()) == 9
    assert rosters.stage_counts(rows.limit(0)).first()["all"] == 0


def test_weights_table(spark):
    stored = spark.createDataFrame([("a", 1.0, "numeric"), ("b", 2.0, "numeric"), ("c", None, "categorical")], "attribute string, weight double, kind string")
    edits = spark.createDataFrame([(1, "a", "3"), (2, "a", "0.5"), (3, "a", "-1"), (4, "a", "NaN"), (5, "b", None), (6, "gone", "1"), (7, "c", "Infinity"), (8, "c", "zero")], "edit_id int, attribute string, weight string")
    after = scoring.edited_weights(stored, edits)
    assert {r.attribute: r.weight for r in after.collect()} == {"a": 0.5, "b": 1.0, "c": 1.0}
    items = spark.createDataFrame([(1, {"a": 1.0, "b": 9.0}, {"c": "x"})], "item int, numbers map<string,double>, values map<string,string>")
    ranges = {"a": (0.0, 2.0, 1.0), "b": (0.0, 2.0, 1.0)}
    told = spark.createDataFrame([("p", "Video", ranges, {"c": {"x": 50.0}})], "p string, media string, ranges map<string,struct<low:double,high:double,median:double>>, shares map<string,map<string,double>>")
    score = lambda w: scoring.complete_scores(items, told, "item", "p", w).first().score
    assert score(after) == score({"a": 0.5}) and score(after.where("attribute = 'none'")) == score(None) and score(after) != score(None)


def test_targets_of_rewrites(spark):
    scores = lambda *rows: spark.createDataFrame(rows, "t int, p string, score double")
    targets = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "t int, p string")
    got = {(r.t, r.p): (r.delta, r.is_target) for r in views.deltas(scores((1, "a", 10.04)), scores((1, "a", 12.0), (1, "b", 1.0), (2, "a", None)), ["t", "p"], targets).collect()}
    assert got == {(1, "a"): (2.0, True), (1, "b"): (None, False), (2, "a"): (None, False)}


def test_constraints_and_what_breaks_them(spark):
    stored = spark.createDataFrame([("p", "banned_word", "So"), ("p", "banned_word", "So"), ("q", "banned_tone", "dry")], "p string, kind string, value string")
    edits = spark.createDataFrame([(1, "p", "banned_word", "So", "remove"), (2, "p", "banned_word", " So ", "add"), (3, "q", "banned_tone", "dry", "remove"), (4, "q", "banned_format", "List", "add"), (5, "q", "banned_odd", "x", "add"), (6, "q", "banned_word", None, "add"), (7, "p", "banned_tone", "Cold", "add"), (8, "p", "banned_tone", "Cold", "drop")], "edit_id int, p string, kind string, value string, action string")
    after = cards.constraints_after(stored, edits, "p")
    assert sorted(map(tuple, after.collect())) == [("p", "banned_tone", "Cold"), ("p", "banned_word", "So"), ("q", "banned_format", "List")]
    texts = spark.createDataFrame([(1, "p", "so SO some", "cold", None), (2, "p", None, "COLD", "list"), (3, "q", "so", "cold", "how"), (4, None, "so", "cold", "list")], "i int, p string, text string, tone string, form string")
    got = {tuple(r) for r in cards.constraint_uses(texts, after, "p", "i", "text", "tone", "form").collect()}
    assert got == {("p", "banned_word", "so", 1, 2), ("p", "banned_tone", "cold", 2, 2), ("q", "banned_format", "list", 0, 0)}


def test_creations_of_a_status_and_profile(spark):
    made = spark.createDataFrame([(1, "a", "done", "P.1", 7, None, "1"), (2, "b", "done", "P.2", None, 9, "3"), (3, "c", "planned", "P.1", None, None, None), (4, "d", "done", "P.1", 99, 9, "1")], "creation int, title string, status string, profile string, input int, spec int, made string")
    inputs, specs = spark.createDataFrame([(7, "in")], "input int, title string"), spark.createDataFrame([(9, "sp")], "spec int, title string")
    got = lambda **asked: [(r.creation, r.input_title, r.spec_title) for r in rosters.production_creations(made, inputs, specs, **asked).collect()]
    assert got() == [(2, None, "sp"), (4, None, "sp"), (1, "in", None), (3, None, None)]
    assert got(status="done", profile="P.1") == [(4, None, "sp"), (1, "in", None)] and got(status="gone") == []
