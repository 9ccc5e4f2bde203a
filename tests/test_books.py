from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import books

SHELF = "book int, title string, author string, subject string, year int, words int, added int, read int, classified_by string"
ROWS = [(1, "beta", "Zoe", "Science", 2001, 10, 1, 1, "model"), (2, "Alpha", "adam", None, None, 30, 3, None, None), (3, "alpha", "Zoe", "Odd", 1999, 20, 2, 0, "needs_review"), (4, None, "Zoe", "Science", 2001, None, 4, 1, "pending")]


def test_orders_and_filters_of_books(spark):
    shelf = spark.createDataFrame(ROWS, SHELF)
    ids = lambda **asked: [r.book for r in books.book_list(shelf, ["Science"], **asked).collect()]
    assert ids() == ids(order="odd") == [4, 2, 3, 1]
    assert ids(order="title") == [4, 2, 3, 1] and ids(order="author") == [2, 4, 3, 1]
    assert ids(order="year") == [4, 1, 3, 2] and ids(order="words") == [2, 3, 1, 4] and ids(order="subject") == [2, 3, 4, 1]
    assert ids(status="classified") == [1] and ids(status="pending") == [4, 2] and ids(status="needs_review") == [3]
    assert ids(read="read") == [4, 1] and ids(read="unread") == [2, 3]
    assert ids(subject="Science") == [4, 1] and ids(subject="Unassigned") == [2, 3] and ids(subject="Odd") == [4, 2, 3, 1]
    assert ids(text="ALPH") == [2, 3] and ids(text="zo", read="read", order="words") == [1, 4]
    none = books.book_list(shelf.where("book > 9"), ["Science"], text="a")
    assert none.collect() == []


def test_first_editions(spark):
    rows = [(3, "a", "t"), (1, "a", "t"), (2, "b", "t"), (4, None, "t"), (5, "a", None), (6, "a", None)]
    got = books.first_editions(spark.createDataFrame(rows, "book int, author string, title string"), "author", "title", "book")
    assert sorted(r.book for r in got.collect()) == [1, 2, 5]


def test_excluded_is_beside_the_status(spark):
    rows = spark.createDataFrame([(1, "A.1", "classified", 1, "Ad", "x", 5), (2, "A.1", "classified", None, "b", "Adam", 5), (3, "B.1", "pending", 0, None, None, 9)], "input int, profile string, status string, excluded int, title string, account string, added int")
    ids = lambda **asked: [r.input for r in books.format_input_list(rows, **asked).collect()]
    assert ids() == [3, 2, 1] and ids(status="excluded") == [1] and ids(status="classified") == [2, 1] and ids(profile="A.1", text="ad") == [2, 1]


def test_creations_and_their_value(spark):
    made = spark.createDataFrame([(1, "p", "T", "l", "m", 1), (2, "p", None, "x", "n", 2), (3, "q", "t", "y", "m", 3)], "c int, profile string, title string, label string, made_by string, made_at int")
    scores = spark.createDataFrame([(1, "p", 80.0, 50.0), (1, "q", 99.0, 1.0), (3, "q", 60.0, 55.0)], "c int, profile string, score double, before double")
    ids = lambda **asked: [(r.c, r.gain) for r in books.creation_list(made, scores, "c", "profile", **asked).collect()]
    assert ids() == [(3, 5.0), (2, None), (1, 30.0)] and ids(order="gain") == [(1, 30.0), (3, 5.0), (2, None)] and ids(order="gain", up=True) == [(2, None), (3, 5.0), (1, 30.0)]
    assert ids(least=10.0) == [(1, 30.0)] and ids(only="q") == [(3, 5.0)] and ids(text="t") == [(3, 5.0), (1, 30.0)] and ids(made_by="n") == [(2, None)]
    rows = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 3.0, "odd": 9.0},), (None,), ({},)], "breakdown map<string,double>")
    got = {r.macro: (r.weight, r.share, r.valued, r.total) for r in books.creations_valuation(rows, {"form": ["a", "b"]}, {"a": 2.0}).collect()}
    assert {m: (w, round(s, 3), v, t) for m, (w, s, v, t) in got.items()} == {"form": (5.0, 83.333, 2, 4), "Other": (1.0, 16.667, 2, 4)}


def test_books_are_scored_against_books(spark):
    items = spark.createDataFrame([(1, {"q": 1.0}, {"lang": "en"}), (2, None, None)], "item int, numbers map<string,double>, values map<string,string>")
    profiles = spark.createDataFrame([("b", "Book", "draft", {"q": (0.0, 1.0, 0.5)}, {"lang": {"en": 50.0}}), ("v", "Video", "confirmed", None, None)], "p string, media string, status string, ranges map<string,struct<low:double,high:double,median:double>>, shares map<string,map<string,double>>")
    got = {r.item: (r.p, r.score, r.n_attributes, r.place) for r in books.book_scores(items, profiles, "item", "p").collect()}
    assert got == {1: ("b", 60.0, 2, 1), 2: ("b", 0.0, 0, 1)}
    more = profiles.union(profiles.where("p = 'b'").withColumns({"p": F.lit("c"), "status": F.lit("confirmed")}))
    assert {r.p for r in books.book_scores(items, more, "item", "p").collect()} == {"c"}
