"""Merge-type pieces, hard negatives and fill-in-middle against the library, brute force and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fim, negatives, pieces

DOCS = "doc_id long, text string"
ODD = ["", None, " ", "  ", "   x", "a  b   c    d ", "a\nb\tc\r\n", "▁▁x ▁", "<s>é中\x00z", "<0x41></s>", "ﬁ Ａ", "日本語 テキスト", "　x\xa0y", "🙂🙂 ok", "don't I'LL 12½Ⅷ²", "aaaaaaaab" * 400, " " * 1000 + "end", "word " * 3000, "x" * 5000, "same", "same"]


@pytest.fixture(scope="module")
def model():
    paths = pytest.importorskip("public_tokenizers")
    path = paths.path("piece_bpe_32k.model")
    import sentencepiece

    return path, sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)


def test_pieces_equal_the_library(spark, model):
    path, library, _ = model
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("y"))
    got = {r.doc_id: r for r in pieces.roundtrip(frame, path).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = library.encode(t or "")
        assert got[i].ids == want and got[i].decoded == library.decode(want)
    assert pieces.digests(frame.where("doc_id > 99"), path).collect() == []
    one = pieces.digests(frame.where("doc_id = 8"), path).first()
    want = library.encode(ODD[8])
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and one.n_tokens == len(want)
    assert one.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_pieces_of_drawn_texts(model):
    _, library, own = model
    draw = random.Random(5)
    letters = ["a", "b", "e", "t", "h", "i", "ing", " th", " ", "  ", "▁", "é", "中", "\n", "ß", "🙂", "0", ".", "<", "\x00", "ﬁ"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(2000)]
    vocabulary = list(own.text.values())
    texts += ["".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 6))).replace("▁", " ") for _ in range(3000)]
    texts += ["a" * (k % 2) + " " * k + w for k in range(1, 70) for w in ("", "x", "the", "中")]
    assert [own.encode(t) for t in texts] == library.encode(texts, num_threads=1)


def test_a_taken_piece_is_given_up():
    """The longest piece doesn't always stand: the encoder has to go back over places that fail."""
    paths = pytest.importorskip("public_tokenizers")
    own = pieces.Pieces(paths.path("piece_bpe_32k.model"))
    made = {}
    for t in ["▁" + a + b for a in ("erung", "hathing", "anlyshat", "outre") for b in ("verach", "ingly", "sat", "iais")]:
        parts = [own.id[c] for c in t]
        while True:  # merging, pair by pair
            ranks = [own.rank.get(own.id.get(own.text[a] + own.text[b], -1), pieces.NEVER) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == pieces.NEVER:
                break
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [own.id[own.text[parts[k]] + own.text[parts[k + 1]]]]
        made[t] = parts
    assert {t: own.backtracked(t) for t in made} == made


def test_decoding_of_drawn_ids(model):
    _, library, own = model
    draw = random.Random(6)
    pool = [0, 1, 2, 28705, 259, 2287, 15043, *range(3, 259, 7), 3 + 0xE2, 3 + 0x82, 3 + 0xAC, *(draw.randrange(own.surface.__len__()) for _ in range(50))]
    lists = [[draw.choice(pool) for _ in range(draw.randrange(7))] for _ in range(4000)]
    got = own.decode_rows(pa.array([*lists, None], pa.list_(pa.int32()))).to_pylist()
    assert got == [*map(library.decode, lists), ""]


def mined(rows, every=100, k=5):
    """Brute force over Python integers."""
    good = [(v, lab, [int(np.floor(256 * x)) for x in e]) for v, e, lab in rows if v is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (a, la, qa) in enumerate(good):
        if a % every:
            continue
        all_ = sorted((-sum(x * y for x, y in zip(qa, q)), v, lab) for j, (v, lab, q) in enumerate(good) if j != i)
        for s, p, lab in [x for x in all_ if x[2] == la][:k]:
            fits = [x for x in all_ if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, r, v, -s, -t) for r, (t, v, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 19)) * 0.2
    rows = []
    for i in range(700):  # a third share one label, copies of vectors stand under several labels
        v = base[i % 12] + rng.normal(scale=0.05, size=19) if i % 5 else base[i % 12]
        rows.append((i, v.tolist(), 0 if i % 3 == 0 else i % 4))
    rows += [(1000, None, 1), (1100, [None] * 19, 1), (1200, [float("nan")] * 19, 0), (1300, [float("inf")] * 19, 0), (1400, base[0].tolist(), None), (None, base[0].tolist(), 0), (1500, [], 0), (1600, base[1][:5].tolist(), 2), (1700, [0.0] * 19, 1), (1800, [900.0] * 19, 3), (1900, [-899.0] * 19, 3)]
    rows += [(2000, base[2].tolist(), 1), (2000, base[2].tolist(), 1)]  # one id twice
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("block", F.lit(0))
    for name, size in (("CANDIDATES", 64), ("ANCHORS", 3), ("TILE", 2), ("TURN", 2), ("BESIDE", 10)):
        monkeypatch.setattr(negatives, name, size)
    assert sorted(map(tuple, negatives.mine(frame, every=50).collect())) == mined(rows, 50)
    assert negatives.mine(frame.where("vec_id < 0")).collect() == []


def test_scores_by_bit_planes_are_exact():
    rng = np.random.default_rng(9)
    for high in (1, 3, 255, 40_000, 1 << 27):
        a, c = rng.integers(-high - 1, high + 1, (5, 21)), rng.integers(-high - 1, high + 1, (33, 21))
        planes, bits = negatives.planes_of(c)
        sums, kind = negatives.subset_sums(a, bits.shape[1], planes)
        assert (negatives.scores(sums, kind, bits) == c @ a.T).all()


def by_hand(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(spark):
    draw = random.Random(4)
    texts = ["", None, "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "<P> a\nb\n", "x<S", "<M", "é\n🙂🙂\n中\r\n\x00", "<<P", "a<P>"]
    texts += ["\n".join("é🙂x "[draw.randrange(4)] * draw.choice([0, 1, 7, 40, 900]) for _ in range(draw.randrange(1, 200))) for _ in range(60)]
    texts += ["line\n" * 30_000, "x" * 500_000 + "\n" + "y" * 500_000, "dup\nlines\n", "dup\nlines\n"]
    rows = [*enumerate(texts), (None, "a\nb\nc")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("index", F.lit("x")).withColumn("output", F.lit("y"))
    got = {r.doc_id: r for r in fim.transform(frame).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    told = {r.doc_id: r for r in fim.digests(frame).collect()}
    assert len(got) == len(told) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in rows:
        n, form, p, m, output = by_hand(i, t or "")
        assert (got[i].n, got[i].form, got[i].prefix, got[i].middle, got[i].output, got[i].back) == (n, form, p, m, output, t or "")
        want = (n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(t or ""))
        assert tuple(told[i])[1:] == want
    assert fim.digests(frame.where("doc_id < 0")).collect() == []
    assert {r.form for r in fim.transform(frame, rate=0).collect()} == {"plain"}


def test_segments_miss_by_no_more_than_they_say():
    rng = np.random.default_rng(3)
    for lines in (rng.integers(1, 9, 5000), rng.integers(1, 4000, 3000), np.ones(200_000, int), np.repeat([1, 5000], 200), np.array([1 << 30, 1, 1 << 29])):
        offsets = np.append(0, np.cumsum(lines)).astype(np.int64)
        starts, bases, slopes = fim.segments(offsets)
        gap = np.frombuffer(fim.missed(offsets, starts, bases, slopes), np.uint8).astype(int) - 128
        assert np.abs(gap).max() <= fim.OFF + 1
        assert max(np.diff([*starts, len(offsets)])) <= (1 << fim.SCALE) + 1
    assert len(fim.segments(np.arange(50_000) * 7)[0]) == 1


def test_licence_notices_as_they_are_written(spark):
    from corpusloom.llm import licenses

    gpl = "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
    cases = {
        "# SPDX-License-Identifier: MPL-2.0": "mpl-2",
        "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": "gpl-2",
        gpl % 2: "gpl-2",
        gpl % 3: "gpl-3",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc,cc-by-nc-sa",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2",
        "Redistributions of source code must retain the above copyright notice. Neither the name nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd,bsd-3",
        "spdx license 2 0 identifier mpl, the software foundation of general public use": "",
        "SPDX-License-Identifier:": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    weight = licenses.idf(rows)
    assert weight["spdx"] < weight["unencumbered"] and min(weight.values()) > 0
