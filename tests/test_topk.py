from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from corpusloom.operators import matching, pages, topk


def every(asked, known, k, least=0.0, last=False):
    """All pairs in plain Python: query to its k best (doc, score)."""
    out, docs = {}, {}
    for d, t, y in known:
        docs.setdefault(d, {})[t] = y
    queries = {}
    for q, t, x in asked:
        queries.setdefault(q, {})[t] = x
    for q, terms in queries.items():
        sums = [(d, round(sum(x * held[t] for t, x in terms.items() if t in held), 9)) for d, held in docs.items()]
        sums = [(d, s) for d, s in sums if s > 0 and s >= least]
        out[q] = sorted(sums, key=lambda r: (-r[1], -r[0] if last else r[0]))[:k]
    return {q: r for q, r in out.items() if r}


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.q, r.place)):
        out.setdefault(r.q, []).append((r.d, round(r.score, 9)))
    return out


def test_best_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    for k, least, last in ((1, 0.0, False), (3, 0.0, True), (2, 7.0, True)):
        # words of very unlike frequency; word 0 stands everywhere; whole numbers make ties
        word = lambda: int(rng.paretovariate(0.7)) % 60
        asked = [(q, t, float(rng.randint(1, 3))) for q in range(60) for t in {0, *(word() for _ in range(6))}]
        known = [(d, t, float(rng.randint(1, 3))) for d in range(80) for t in {0, *(word() for _ in range(9))}]
        a, b = spark.createDataFrame(asked, "q long, t long, x double"), spark.createDataFrame(known, "d long, t long, y double")
        assert found(topk.best_matches(a, b, ["q"], ["d"], ["t"], k, least, last=last).collect()) == every(asked, known, k, least, last)


def test_weak_terms_meet_no_docs(spark):
    # every doc holds the common word; only those of the rare one may be met
    asked = spark.createDataFrame([(1, "common", 1.0), (1, "rare", 5.0)], "q long, t string, x double")
    known = spark.range(500).select(F.col("id").alias("d"), F.lit("common").alias("t"), F.lit(1.0).alias("y")).union(spark.createDataFrame([(7, "rare", 1.0)], "d long, t string, y double"))
    (row,) = topk.best_matches(asked, known, ["q"], ["d"], ["t"]).collect()
    assert (row.d, row.score, row.place) == (7, 6.0, 1)


def test_cosines_and_overlaps(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (3, None)], "i long, word string")
    b = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x"), ("r", "x"), ("r", "x"), ("r", "y"), ("s", "y")], "c string, word string")
    got = topk.best_cosines(a, b, "i", "c", 2).collect()
    assert [(r.i, r.c, r.cosine) for r in sorted(got, key=lambda r: r.place)] == [(1, "r", 1.0), (1, "p", round(3 / 10**0.5, 9))]
    best = topk.best_overlaps(a, b, "i", "c", 2).orderBy("place").collect()
    assert [(r.c, r.shared, r.overlap) for r in best] == [("p", 2, 1.0), ("r", 2, 1.0)]
    none = b.where("false")
    assert topk.best_cosines(a, none, "i", "c").count() == topk.best_overlaps(a.where("false"), b, "i", "c").count() == 0


def plain_pages(examples, book_pages, least):
    """Each example with each page of its book, as the rule says."""
    out = {}
    for book, item, text in examples:
        if book is None or text is None:
            continue
        tokens = [(t.strip(" "), 3) for t in re.findall(matching.NUMBERS, text)]
        tokens = [(t, w) for t, w in tokens if len(t) > 1]
        tokens += [(t, 2 if " " in t else 1) for t in re.findall(matching.NAMES, text) if re.split(r"\s", t)[0] not in matching.OPENINGS]
        scores = [(sum(w for t, w in tokens if t in page_text), page) for b, page, page_text in book_pages if b == book and page_text is not None]
        best = max((s for s in scores if s[0] >= least), default=None)
        if best:
            out[book, item] = best
    return out


def test_pages_by_tokens_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pages, "PART_CHARS", 3000)
    monkeypatch.setattr(pages, "PART_TOKENS", 40)
    rng = random.Random(3)
    words = ["Marshall", "Keynes", "Adam Smith", "Bank of England", "Paris", "the Fed", "McDonald", "Donald", "12%", "$3.5 trillion", "1997", "97", "7", "12 percent", "lower", "Äpfel", "So Far Away"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    examples = [(rng.choice(["a", "a", "a", "b"]), i, text(rng.randint(1, 6))) for i in range(120)] + [(None, 900, "Keynes 1997"), ("a", 901, None), ("a", 902, ""), ("none", 903, "Keynes 1997")]
    book_pages = [(rng.choice(["a", "a", "a", "b"]), p, text(rng.randint(1, 9))) for p in range(150)] + [("a", 500, None), ("a", 501, ""), (None, 1, "Keynes"), ("b", 0, "Paris " * 5000)]
    book_pages += [("a", 3, "Keynes 1997 12%"), ("a", 3, "Keynes 1997 12%")]  # a page key on two texts, one of them twice
    e = spark.createDataFrame([(*r, 1) for r in examples], "book string, item long, example string, t int")
    p = spark.createDataFrame([(*r, 1) for r in book_pages], "book string, page int, page_text string, item int")
    for least in (4, 1):
        got = {(r.book, r.item): (r.score, r.page) for r in pages.page_match(e, p, "book", "item", F.col("example"), "page", "page_text", least).collect()}
        assert got == plain_pages(examples, book_pages, least)


def test_tokens_part_at_letters_of_other_scripts(spark):
    """As in SQL, where word boundaries and blanks are those of ASCII."""
    texts = ["Die Straße am Fluss", "éParis", "Mün München Zürich", "Adam\x0bSmith Adam\nSmith", "12\x0bmillion 12\tmillion", "Keynes_ Keynes1"]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "book string, item int, text string")
    got = {(r.item, r.t): r.w for r in matching.example_tokens(rows, "book", "item", F.col("text")).collect()}
    con, want = duckdb.connect(), {}
    for i, t in enumerate(texts):
        found = [(x.strip(" "), 3) for x in con.execute("select regexp_extract_all(?, ?)", [t, matching.NUMBERS]).fetchone()[0]]
        found += [(x, 2 if " " in x else 1) for x in con.execute("select regexp_extract_all(?, ?)", [t, matching.NAMES]).fetchone()[0]]
        for x, w in found:
            if len(x) > 1:
                want[i, x] = want.get((i, x), 0) + w
    assert got == want and (0, "Die Stra") in got and (1, "Paris") in got
