from __future__ import annotations

import math
import os
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import members


def corpus(n: int):
    """About 2n texts, short and long: words of a small stock, one frequent run in half of them, edits spread or in one place,
    digits and one-letter texts."""
    rng = np.random.default_rng(3)
    weight = np.array([12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5])
    stock = ["".join(rng.choice(list("etaoinshrdlucmfwypvbgkqjxz"), int(k), p=weight / weight.sum())) for k in rng.integers(2, 9, 150)]
    run = " ".join(rng.choice(stock, 30))
    say = lambda n: " ".join(rng.choice(stock, int(n)))
    base = [say(n) for n in np.concatenate((rng.integers(1, 30, n // 2), rng.integers(30, 160, n // 2)))]
    base = [f"{t} {run}" if k % 2 else t for k, t in enumerate(base)]
    texts = list(base)
    for k in rng.integers(0, len(base), n):
        t, how = list(base[k]), int(rng.integers(0, 5))
        if how == 0:  # a letter in every few words
            for i in range(3, len(t), int(rng.integers(5, 30))):
                t[i] = "q"
        elif how == 1:
            t[len(t) // 2 : len(t) // 2] = list(" " + say(3))
        elif how == 2:
            del t[: len(t) // 8]
        elif how == 3:
            t = [c for i, c in enumerate(t) if i % int(rng.integers(9, 20))]
        else:
            t = list("".join(t).upper() + "!!")
        texts.append("".join(t))
    texts += ["a", "b", "ab", "abc", "abcd", "", "'", "7", "7 7", "z" * 300, "z" * 299 + "y", "0123456789" * 40, "0123456789" * 39 + "abcdefghij"]
    digits = lambda n: "".join(rng.choice(list(members.ALPHABET[:-1]), n))
    for _ in range(40):  # hardly a common character
        t = digits(230)
        texts += [t, t[:100] + "zz" + t[104:]]
    return texts


def test_members_lose_no_pair(spark):
    texts = corpus(int(os.environ.get("MEMBERS", "300")))  # 1000 takes minutes: all pairs are compared
    norm = [t.lower().replace("!", "").strip() for t in texts]
    names = {t: i for i, t in reversed(list(enumerate(norm))) if t}
    frame = spark.createDataFrame([(i, t) for t, i in names.items()], "x long, norm string")
    got = {(r.x, r.y): round(r.similarity, 9) for r in members.similar(frame, frame.withColumnRenamed("x", "y"), 0.85).collect()}
    plain = list(names.items())
    parts = spark.sparkContext.parallelize(range(len(plain)), 64)

    def ratios(k):
        b, y = plain[k]
        m = SequenceMatcher(None, "", b)
        for a, x in plain:
            if x != y:
                m.set_seq1(a)
                if m.real_quick_ratio() >= 0.85 and (r := m.ratio()) >= 0.85:
                    yield (x, y), round(r, 9)

    want = dict(parts.flatMap(ratios).collect())
    assert len(want) > 100 and got == want


def test_members_of_accounts(spark):
    long = "the quick brown fox jumps over the lazy dog and then the dog sleeps " * 6
    rows = [(1, "a", "Same  text"), (2, "b", "same text!"), (3, "b", "SAME TEXT"), (4, "a", long), (5, "b", long + "x"), (6, None, "same text"), (7, "a", None), (8, "b", "  "), (9, "a", long + "zz")]
    frame = spark.createDataFrame(rows, "item long, account string, text string")
    got = sorted((r.item, r.account, r.match, r.matched) for r in members.membership(frame, frame.withColumnRenamed("item", "owned"), "item", "text", "account", "owned").collect())
    assert got == [(1, "b", "exact", 2), (2, "a", "exact", 1), (2, "b", "exact", 3), (3, "a", "exact", 1), (3, "b", "exact", 2), (4, "a", "exact", 9), (4, "b", "exact", 5), (5, "a", "exact", 4), (6, "a", "exact", 1), (6, "b", "exact", 2), (9, "a", "exact", 4), (9, "b", "exact", 5)]
    none = frame.where("item > 99")
    assert members.membership(none, none.withColumnRenamed("item", "owned"), "item", "text", "account", "owned").collect() == []


def test_texts_that_normalise_to_nothing_are_told_without_it(spark):
    texts = ["", None, "  ", "“”—!", "é ß", "’", "‘a", "K", "İ", "\x0b7", "Ж", "'"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalised(F.col("t")).alias("n"), T.has_normalised(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [r.n != "" for r in rows]


def test_members_of_one_table_write_texts_once(spark, monkeypatch):
    long = "the quick brown fox jumps over the lazy dog and then the dog sleeps " * 6
    rows = [(1, "a", "Same  text"), (2, "b", "same text!"), (4, "a", long), (5, "b", long + "x"), (6, None, "same text"), (7, "a", None), (8, None, long + "zz"), (None, "a", long)]
    frame = spark.createDataFrame(rows, "item long, account string, text string")
    told = lambda d: sorted(tuple(r) for r in d.collect())
    want = told(members.membership(frame, frame.withColumnRenamed("item", "owned"), "item", "text", "account", "owned"))
    texts, write = [], members.staged
    monkeypatch.setattr(members, "staged", lambda d, name, *more: [texts.append(name) if "norm" in d.columns else None, write(d, name, *more)][1])
    got = told(members.membership(frame, None, "item", "text", "account", "owned"))
    assert got == want and len(got) == 8 and texts == ["rows", "texts"]
    assert told(members.membership(frame, None, "item", "text", "account", "owned", near=None)) == [r for r in want if r[3] == 1.0]


def test_ends_that_the_corpus_lacks_are_dropped_where_they_are_made(spark):
    texts = [t for t in corpus(60) if len(t) >= members.LONG]
    codes = [members.CODES[np.frombuffer(t.encode(), np.uint8)] for t in texts[:20]]
    keys = sorted({int(k) for c in codes if (f := members.chosen(c, 0.85)) for k in members.keys_of(c, f[0], f[2], f[3])[0]})
    held = members.sketch_of(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert all(held[k % members.BITS >> 3] >> (k % members.BITS & 7) & 1 for k in keys)
    assert sum(b.bit_count() for b in held) <= len(keys)
    batch = pa.RecordBatch.from_pydict({"x": list(range(len(texts))), "norm": texts, "sizes": [list(members.ENDS)] * len(texts), "rare": [(1 << 39) - 1] * len(texts)})
    made = lambda bits: [k for b in members.item_keys(SimpleNamespace(value=bits))([batch]) for k in b.column("key").to_pylist()]
    every, some = made(b"\xff" * len(held)), made(held)
    assert len(some) < len(every) and [k for k in every if k in set(keys)] == [k for k in some if k in set(keys)]


def test_runs_refuse_no_pair_that_reaches_the_ratio():
    texts = [t for t in corpus(100) if t]
    refused = 0
    for k, b in enumerate(texts):
        for a in texts[k % 7 :: 7]:
            least = math.ceil(0.425 * (len(a) + len(b)) - 1e-6)
            if min(len(a), len(b)) >= least and not members.runs_allow(a, b, least):
                refused += 1
                assert SequenceMatcher(None, a, b).ratio() < 0.85
    assert refused > 20


def test_ratio_is_that_of_the_matching_blocks():
    texts = [t for t in dict.fromkeys(corpus(60)) if t and not set(t) - set(members.ALPHABET)]
    held, found = [members.Text(t.encode()) for t in texts], 0
    for k, b in enumerate(texts):
        for i in range(k % 11, len(texts), 11):
            want = SequenceMatcher(None, texts[i], b).ratio()
            for near in (0.0, 0.85):
                assert members.ratio(held[i], held[k], near) == (want if want >= near else None)
            found += want >= 0.85
    assert found > 20
    x, y = members.Text(texts[40].encode()), members.Text(texts[80].encode())
    assert members.ratio(x, y, 0.0) == SequenceMatcher(None, texts[40], texts[80]).ratio()


def test_both_ways_to_find_blocks_are_one(monkeypatch):
    texts = [members.Text(t.encode()) for t in dict.fromkeys(corpus(40)) if len(t) >= members.LONG and not set(t) - set(members.ALPHABET)]
    one = [members.ratio(a, b, 0.0) for a in texts for b in texts[::5]]
    monkeypatch.setattr(members, "FEW", -1)
    assert one == [members.ratio(a, b, 0.0) for a in texts for b in texts[::5]]


def test_index_holds_no_more_runs_than_the_bound_needs():
    seldom = np.zeros(1 << 24, np.uint8)
    rows = ends = 0
    for t in corpus(60):
        codes = members.CODES[np.frombuffer(t.lower().replace("!", "").strip().encode(), np.uint8)]
        if not (found := members.chosen(codes, 0.85)):
            continue
        s, _, bounds, beyond = found
        key, run, held, _ = members.keys_of(codes, s, bounds, beyond)
        kept, rest = members.needed_runs(len(codes), 0.85, key, run, held, seldom)
        size = dict(zip(run[kept].tolist(), held[kept].tolist(), strict=True))
        least = members.least_of(len(codes), 0.85)
        assert rest == len(codes) - sum(size.values()) < least <= rest + min(size.values()) + (len(size) > 1) * len(codes)
        assert not set(run[kept].tolist()) & set(run[~kept].tolist())
        rows, ends = rows + int(kept.sum()), ends + 2 * (len(bounds) - 1)
    assert 0 < rows < ends / 3


def test_frequent_ends_are_left_out_first(spark):
    rng = np.random.default_rng(5)
    often = np.zeros(1 << 24, np.uint8)
    key, run, beyond = rng.integers(-(2**63), 2**63 - 1, 20), np.repeat(np.arange(10), 2), np.full(20, 50)
    often[key[:8].view(np.uint64) >> np.uint64(40)] = 9
    kept, _ = members.needed_runs(1000, 0.85, key, run, beyond, often)
    assert not kept[:8].any() and kept[8:].any()
    text = " ".join("".join(rng.choice(list("etaoinshrqjxzk"), 6, p=[0.2, 0.15, 0.15, 0.1, 0.1, 0.1, 0.07, 0.06, 0.04, 0.01, 0.005, 0.005, 0.005, 0.005])) for _ in range(150))
    codes = members.CODES[np.frombuffer(text.encode(), np.uint8)]
    s, _, bounds, beyond = members.chosen(codes, 0.85)
    key = members.keys_of(codes, s, bounds, beyond)[0]
    told = members.often_of(spark.createDataFrame([(text, s)] * 20, "norm string, s int").repartition(3))
    assert {told[k] for k in (key.view(np.uint64) >> np.uint64(40)).tolist()} == {4} and len(told) - told.count(0) <= len(key)


def test_an_item_with_two_texts_keeps_them_apart(spark):
    rng = np.random.default_rng(7)
    one, two = (" ".join("".join(rng.choice(list("etaoinshrdluqzk"), 5)) for _ in range(80)) for _ in range(2))
    rows = [(1, "a", one), (1, "b", two), (2, "c", one + " x"), (3, "d", two + " y")]
    frame = spark.createDataFrame(rows, "item long, account string, text string")
    want = [(1, "c", 2), (1, "d", 3), (2, "a", 1), (3, "b", 1)]
    for corpus_of in (None, frame.withColumnRenamed("item", "owned")):
        got = members.membership(frame, corpus_of, "item", "text", "account", "owned")
        assert sorted((r.item, r.account, r.matched) for r in got.collect()) == want


def test_large_buckets_are_parted_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(members, "BUCKET", 3)
    monkeypatch.setattr(members, "BLOCK", 4)
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("etaoinshr qjxzk"), 400, p=[0.17, 0.13, 0.1, 0.1, 0.1, 0.1, 0.07, 0.06, 0.06, 0.06, 0.01, 0.01, 0.01, 0.01, 0.01]))
    short = text[:90]
    texts = [f"{t[:k]}{'xy'[k % 2]}{t[k:]}" for t in (text, short) for k in range(20, 20 + 3 * 14, 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "x long, norm string")
    got = {(r.x, r.y) for r in members.similar(frame, frame.withColumnRenamed("x", "y"), 0.85).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert got == want and sum(i < 14 for i, _ in want) > 100 and len(want) > 250
