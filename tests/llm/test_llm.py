from __future__ import annotations

import collections
import hashlib
import math
import re
import tracemalloc
import uuid
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, jaccard, licenses, neardup, packing, quality, sharding, tokencounts, toxicity
from corpusloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "  a  b", "a\n  b  \n", "Σας ΣΑΣ Σ", "İstanbul Å é x", "don't I'LL x's 12½Ⅷ²", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "\x1ca\x1db", "🙂🙂 ok", "   lead", "trail   ", "a\x85b　c", "aaaaaaaab" * 40, "漢字 test", "word " * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(spark, name):
    paths = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = paths.path(name)
    t = Tokenizer.from_file(path)
    for r in bpe.roundtrip(docs(spark, ODD), path).collect():
        want = t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == t.decode(want, skip_special_tokens=False)



def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base, base[:10] + rng.normal(scale=0.02, size=(10, 16)), base[:3], base[:1] + rng.normal(scale=0.01, size=(30, 16))])
    rows = [(i, x.tolist(), i % 2 if i < 50 else 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, v[0].tolist(), None), (904, [None] * 16, 1), (None, v[0].tolist(), 0)]
    got = {r.vec_id: r for r in neardup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=16).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows[: len(v)]])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(v))] == near.sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in [*range(900, 905), None])
    reach = np.arange(len(v))
    for _ in v:
        reach = np.array([min([reach[i], *reach[near[i]]]) for i in range(len(v))])
    assert [got[i].component_id for i in range(len(v))] == reach.tolist()
    assert all(got[i].kept == (reach[i] == i) for i in range(len(v)))


def test_near_duplicates_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (3, [0.0, 2.0], 0), (2, [1.0, 0.01], 0), (5, [1.0, 0.0, 0.0], 0), (4, [-1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = sorted(map(tuple, neardup.links(frame).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert neardup.links(frame.where("vec_id > 9")).collect() == []


def test_audits_count_true_links():
    rng = np.random.default_rng(4)
    v = neardup.unit(rng.normal(size=(600, 24)))
    v[:40] = neardup.unit(v[100:140] + rng.normal(scale=0.01, size=(40, 24)))
    audit, truth = neardup.audited(v, v, 0.98)
    assert len(audit) == 600 and truth.sum() == 80 or truth.sum() >= neardup.LINKS
    found = neardup.search(v, neardup.Graph(v), v, 0.98)
    np.fill_diagonal(found, False)
    want = v @ v.T >= 0.98
    np.fill_diagonal(want, False)
    assert neardup.recall(found, want) >= 0.99 and not (found & ~want).any()


def test_licences(spark):
    texts = ["Released under the MIT License.", "x Apache License, Version 2.0 y cc by-nc", "This work is licensed under the GNU General Public License, version 3.", None, "", "All rights reserved.", "under the, mit; license under the mit license", "mit under the license gnu public general"]
    got = [licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()][0]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [
        (5, 1, 1, 1, "mit", "mit"),
        (10, 2, 1, 7, "apache-2,cc-by-nc", "apache-2,cc-by-nc"),
        (12, 0, None, None, "", "gpl-3"),
        (0, 0, None, None, "", ""),
        (0, 0, None, None, "", ""),
        (3, 0, None, None, "", "all-rights-reserved"),
        (8, 2, 0, 4, "mit", "mit"),
        (7, 0, None, None, "", ""),
    ]
    assert all(0 <= r.score <= 1 for r in got)


def test_licences_of_several_notices(spark):
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    several = [notices[2], notices[12], notices[6], notices[14]]
    texts = [" zz ".join(several), " zz ".join(notices), " zz ".join(notices[::-1] * 2), "", *notices]
    got = licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()
    every = ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert [r.labels for r in got[:4]] == ["all-rights-reserved,bsd,cc-by-sa,mit", every, every, ""]
    for r, (label, _, _) in zip(got[4:], licenses.TEMPLATES, strict=True):
        assert label in r.labels.split(",") and r.score == 1


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and low[i] != low[j] and 100 * len(a & b) >= 75 * len(a | b):
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return [len(s) for s in sets], low


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    texts = [text(int(n)) for n in rng.integers(1, 60, 60)]
    hub = text(80).split()
    for _ in range(40):  # a crowd of near copies
        x = list(hub)
        for k in rng.integers(0, 80, 2):
            x[k] = str(rng.choice(words))
        texts.append(" ".join(x))
    line = " ".join(hub[:20])
    texts += [texts[0], texts[0].upper(), None, "", "a b", "A  b", "a b c"] + [line + " " + text(6) for _ in range(30)]
    got = jaccard.join(docs(spark, texts)).orderBy("doc_id").collect()
    n, low = brute_components(texts)
    assert [r.n_shingles for r in got] == n
    assert [r.component_id for r in got] == low


def crowded_block(k, groups):
    rng = np.random.default_rng(7)
    points = [np.maximum(p, 8).astype(np.uint8).tobytes() for p in rng.integers(0, 10, (k, 8))]
    return rng.permutation(k).astype(np.int64), np.full(k, 72), points, groups, 75


def test_a_crowded_block_never_holds_all_its_pairs():
    k = 3000  # k * (k - 1) / 2 pairs pass the bound: 72 MB as indices
    for groups in (np.arange(k), np.arange(k) % 50):
        block = crowded_block(k, groups)
        tracemalloc.start()
        i, j, crowded = map(list, zip(*jaccard.block_pairs(*block, 0), strict=True))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0.9 * k <= sum(map(len, i)) <= jaccard.TIES * k and any(crowded) and most < 16e6
    assert list(jaccard.block_pairs(*crowded_block(k, np.zeros(k, np.int64)), 2)) == []


def test_turns_list_all_pairs_of_a_block_at_last(monkeypatch):
    for name, value in (("TIES", 1), ("WIDER", 2), ("HELD", 64)):
        monkeypatch.setattr(jaccard, name, value)
    for k in (40, 300):  # a leaf and a tree
        groups = np.arange(k) % 7
        found, turn, crowded = set(), 0, True
        while crowded:
            crowded = False
            for i, j, cut in jaccard.block_pairs(*crowded_block(k, groups), turn):
                assert len(i) <= 64 + k or k == 40
                found |= set(map(tuple, np.sort(np.stack([i, j], 1)).tolist()))
                crowded |= cut
            turn += 1
        assert turn > 3 and found == {(a, b) for b in range(k) for a in range(b) if groups[a] != groups[b]}


def test_the_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(11)
    sizes = np.sort(rng.integers(20, 90, 700))
    points = np.stack([np.bincount(rng.integers(0, 32, n), minlength=32) for n in sizes]).astype(np.uint8)
    points[::9] = points[5]
    points[3, :2] = 255  # no bound where both counts are at their end
    tree, groups = jaccard.Tree(points, sizes), rng.integers(0, 5, 700)
    for q in (5, 3, 17, 400):
        bound = jaccard.shared_at_most(points[q : q + 1], points)[0]
        fits = (100 * np.minimum(sizes, sizes[q]) >= 75 * np.maximum(sizes, sizes[q])) & (bound >= jaccard.needed(sizes, sizes[q])) & (groups != groups[q])
        want = np.flatnonzero(fits & (np.arange(700) > q))
        assert tree.near(points[q], int(sizes[q]), 75, q + 1, 10**6, False, groups, groups[q]).tolist() == want.tolist()
    assert len(tree.levels) > 2


@pytest.mark.parametrize("tile", [jaccard.TILE, 40])
def test_jaccard_of_a_crowd_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 60))
    texts = []
    for k in range(220):  # near copies, many of them too far from each other
        x = list(base)
        for at in rng.integers(0, 60, 1 + k % 3):
            x[at] = str(rng.choice(words))
        texts.append(" ".join(x))
    chain = [" ".join(f"c{i}" for i in range(4 * k, 4 * k + 60)) for k in range(30)]
    texts += chain + [" ".join([*base[:30], *rng.choice(words, 8)]) for _ in range(80)] + chain[:3] + [None, " ", "a\u00a0b c", "x " * 4000]
    got = jaccard.join(docs(spark, texts)).orderBy("doc_id").collect()
    n, low = brute_components(texts)
    assert [r.n_shingles for r in got] == n and [r.component_id for r in got] == low
    assert 30 < len(set(low)) < 300


def test_jaccard_of_repeated_rows_and_clashing_columns(spark):
    d = docs(spark, ["a b c d e f", "A b c d e f", None, "z"]).union(docs(spark, ["a b c d e f", "other"]).where("doc_id = 1")).union(docs(spark, ["q"]).withColumn("doc_id", F.lit(None).cast("long")))
    names = ["_gone", "row", "of", "id", "cid", "n", "low", "group"]
    d = d.withColumns({c: F.lit(c) for c in names})
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect())
    assert got == [(False, 0, 2, 0), (False, 1, 1, 0), (False, 1, 2, 0), (False, 2, 0, 2), (False, 3, 1, 3), (True, None, 1, None)]
    kept = jaccard.keep(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "3", "None"]
    assert all(r[c] == c for r in kept.collect() for c in names)


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 65, 900)] + [30] * 300
    parts = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    rows = packing.place(parts, 64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == len(sizes)
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    rooms: list[int] = []  # best-fit decreasing, one by one
    for n in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - n)
    assert len(by) <= 1.02 * len(rooms) + 1


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be </s> kind"), (1, 1, "user", None), (1, 2, "assistant", "<\\s> [\\n] \\"), (1, 3, None, "[/INST]x\n<s>"), (1, 4, "assistant", "end"), (2, 0, "user\nx", "hi"), (None, 0, "assistant", "y")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"word{k} " * 40) for k in range(30)]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.digests(talk).collect()}
    windows = chat.windows(talk).where("conv_id = 3").collect()
    assert len(windows) > 1 and all(w.tokens <= chat.BUDGET for w in windows) and any(w.repeated for w in windows)
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_shards_match_the_mixture(spark):
    rows = spark.createDataFrame([(i, "t", "en", "a" if i % 3 else None, 1) for i in range(1001)], DOCS)
    got = sharding.layout(rows, shards=7).join(rows.select("doc_id", "source"), "doc_id").collect()
    n = collections.Counter(r.shard for r in got)
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == 1001
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    each = collections.Counter((r.shard, r.source) for r in got)
    for source in ("a", None):
        held = [each[s, source] for s in range(7)]
        assert max(held) - min(held) <= 2


def test_quality_counts(spark):
    texts = ["one two three four five six " * 3, "a b c d e f g h i j k\nx\nx\n\n\n", None, "", "# $ % & | < > * x y z w"]
    got = [r for r in quality.base_rules(docs(spark, texts)).orderBy("doc_id").collect()]
    assert [(r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [(18, 0, 0, 18, True), (13, 0, 1, 0, False), (0, 0, 0, 0, True), (0, 0, 0, 0, True), (12, 8, 0, 0, False)]


def test_label_model_trusts_good_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    fires = lambda hit, wrong: np.where(y, rng.random(4000) < hit, rng.random(4000) < wrong)
    votes = np.stack([fires(0.8, 0.01), fires(0.7, 0.02), fires(0.6, 0.01), fires(0.3, 0.3)], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1], 1 - votes[:, :3].max(1, keepdims=True)])  # a copy is the same evidence
    post, model = toxicity.label_model(votes, np.array([0.9, 0.9, 0.9, 0.3, 0.9, 0.03]))
    assert ((post >= 0.5) == y).mean() > 0.95
    truth = (votes * y[:, None]).sum(0) / votes.sum(0)
    assert np.abs(model["right"] - truth).max() < 0.12
    assert model["keep"][0] < 0.7 and model["right"][0] > model["right"][3]


def test_toxicity_learns_from_voters_and_edges(spark):
    rng = np.random.default_rng(6)
    words = ["stone", "river", "cloud", "paper", "green", "window", "garden", "letter"]
    text = lambda bad: " ".join([*rng.choice(words, 12), *(["zorgling"] if bad else [])])
    rows = [(i, text(i % 5 == 1)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "zorgling " * 50000), (1003, "zorgling"), (1003, "river stone"), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "_score": F.lit(2), "label": F.lit(3)})
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(d, labels).collect()
    assert len(got) == 406
    of = {r.doc_id: r for r in got if r.doc_id != 1003}
    assert [of[i].predicted for i in range(400)] == [int(i % 5 == 1) for i in range(400)]
    assert of[1000].score == of[1001].score < 0.5 < of[1002].score and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.predicted for r in got if r.doc_id == 1003) == [0, 1]
    kept = toxicity.keep(d, labels)
    assert kept.columns == d.columns and kept.count() == 406 - 80 - 2
    assert toxicity.scores(d.where("doc_id > 5000"), labels).collect() == []


def test_toxicity_without_labels(spark):
    d = docs(spark, ["you idiot", "a fine day", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.scores(d, none).orderBy("doc_id").collect()] == [1, 0, 0]


def test_rollup_is_idempotent(spark):
    roll = tokencounts.Rollup(spark, "test-rollup-" + hashlib.sha256(str(spark).encode()).hexdigest()[:8])
    d = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "c", "en", None, 1), (None, "x", "en", "s", 1)], DOCS)
    first = tokencounts.changes(d, ["words-1"], "insert", 0)
    assert roll.apply("one", first) and not roll.apply("one", first)
    told = lambda: sorted((r.source or "", r.n_docs, r.n_tokens) for r in roll.totals.collect())
    assert told() == [("", 1, 1), ("s", 1, 2)]
    roll.apply("two", tokencounts.changes(d.where("doc_id = 1"), ["words-1"], "delete", 1))
    assert told() == [("", 1, 1)]


def test_rollup_knows_commits_after_a_restart(spark):
    name = f"test-restart-{uuid.uuid4().hex}"
    d = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "c", "en", None, 1)], DOCS)
    first, second = (tokencounts.changes(d.where(f"doc_id = {k}"), ["words-1"], "insert", k) for k in (1, 2))
    told = lambda roll: sorted((r.source or "", r.n_docs, r.n_tokens) for r in roll.totals.collect())
    roll = tokencounts.Rollup(spark, name)
    assert roll.apply("one", first) and roll.apply("two", second)
    again = tokencounts.Rollup(spark, name)
    assert not again.apply("two", second) and not again.apply("one", first)
    assert told(again) == [("", 1, 1), ("s", 1, 2)]
    assert again.apply("three", tokencounts.changes(d.where("doc_id = 1"), ["words-1"], "delete", 3))
    # tables without a marker are no commit: the batch is applied when it comes again
    lost = spark.createDataFrame([(2, "words-1", True, "lost", "en", 99)], "doc_id long, version string, alive boolean, source string, lang string, n_tokens long")
    lost.write.parquet(f"{again.states}/seq=3/bucket=0")
    lost.limit(0).write.parquet(f"{again.path}/four/totals")
    last = tokencounts.Rollup(spark, name)
    assert told(last) == [("", 1, 1)] and last.commits == ["one", "two", "three"]
    assert last.apply("four", first) and told(last) == [("", 1, 1), ("s", 1, 2)]


def test_rollup_takes_the_last_change_and_reads_what_it_needs(spark):
    roll = tokencounts.Rollup(spark, f"test-last-{uuid.uuid4().hex}")
    d = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b c", "en", "s", 5), (2, None, None, None, 0), (3, "x", "en", "s", 1)], DOCS)
    assert roll.apply("one", tokencounts.changes(d.withColumn("batch", F.lit(1)), ["words-1", "pieces-1"], "insert", 0))
    told = lambda: sorted((r.source or "", r.version, r.n_docs, r.n_tokens) for r in roll.totals.collect())
    assert told() == [("", "pieces-1", 1, 0), ("", "words-1", 1, 0), ("s", "pieces-1", 2, 4), ("s", "words-1", 2, 4)]
    unknown = tokencounts.changes(d.where("doc_id = 3").withColumn("doc_id", F.lit(77).cast("long")), ["words-1"], "delete", 1)
    moved = tokencounts.changes(d.where("doc_id = 3").withColumn("source", F.lit("t")), ["words-1"], "revise", 1)
    assert roll.apply("two", unknown.union(moved)) and roll.apply("none", moved.where("false"))
    assert told() == [("", "pieces-1", 1, 0), ("", "words-1", 1, 0), ("s", "pieces-1", 2, 4), ("s", "words-1", 1, 3), ("t", "words-1", 1, 1)]
    assert spark.read.parquet(f"{roll.states}/seq=1").count() == 1  # a commit writes what it changes
    assert roll.state().where("alive").count() == 6


def test_chat_windows_around_a_long_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "assistant" if k % 2 else "user", f"w{k} x" * (1200 if k == 30 else 1)) for k in range(1, 61)] + [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"window": F.lit(1), "again": F.lit(2), "k": F.lit(3)})
    got = chat.windows(talk).orderBy("conv_id", "window").collect()
    assert [r.window for r in got] == [0, 1, 2, 0] and sum(r.tokens > chat.BUDGET for r in got) == 1
    assert got[0].repeated == 0 and got[1].repeated > 1 and got[2].repeated == 1  # the long turn fits no history
    back = {r.conv_id: r for r in chat.digests(talk).collect()}
    loss = "".join(t for c, _, role, t in rows if c == 1 and role == "assistant")
    assert (back[1].n_turns, back[1].loss_sha256, back[2].n_turns, back[2].loss_chars) == (61, hashlib.sha256(loss.encode()).hexdigest(), 3, 12)
    assert chat.digests(talk.where("false")).collect() == []


def test_shards_order_equals_brute_force(spark):
    rows = [(i % 97, "x" * (i % 7), ["a", "b", None, "c"][min(3, i % 9)]) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("kept") for c in ("_mark", "_part", "mix", "key", "row", "pos")}).withColumn("shard", F.lit(-1))
    placed = sharding.interleave(d, shards=6).withColumn("h", F.xxhash64(F.lit(sharding.SEED), "doc_id")).collect()
    assert len(placed) == 500 and all(r[c] == "kept" for r in placed for c in ("_mark", "_part", "mix", "key", "row", "pos"))
    by_source = collections.defaultdict(list)
    for r in placed:
        by_source[r.source or "\0"].append((r.h, r.doc_id))
    order = sorted(((k + 0.5) / len(v), s, *x) for s, v in by_source.items() for k, x in enumerate(sorted(v)))
    got = sorted(placed, key=lambda r: (r.shard, r.slot))
    assert [(r.source or "\0", r.h, r.doc_id) for r in got] == [x[1:] for x in order]
    assert [r.shard for r in got] == [k * 6 // 500 for k in range(500)]


def test_shards_are_written_whole(spark, tmp_path):
    d = docs(spark, [f"text {i}" for i in range(50)] + [None])
    sharding.write_shards(d, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in d.collect())
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 13, 13, 13]


def test_packing_of_odd_texts_equals_the_library(spark):
    paths = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = paths.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, "a" + " " * 200_000 + "b", "x" * 9000, "1" * 5000, "word " * 1500]
    d = docs(spark, texts).union(docs(spark, ["again"])).withColumns({"length": F.lit(1), "piece": F.lit(2), "_mix": F.lit(3)})
    rows = packing.pack(d, path).collect()
    own = collections.defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    for i, text in enumerate(texts):
        wants = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in ([text, "again"] if i == 0 else [text])]
        assert sum(r.length for r in own[i]) == sum(map(len, wants))
        if i:
            (ids,) = wants
            cut = sorted(own[i], key=lambda r: r.piece)
            assert [r.start for r in cut] == [0, *np.cumsum([r.length for r in cut])[:-1].tolist()] and all(r.length == 1024 for r in cut[1:])
            assert [r.ids_crc32 for r in cut] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in cut]
    assert packing.pack(d.where("false"), path).collect() == []


WORDS3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_labels(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORDS3, low)
    at = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in at(phrase)]
    labels = {label for _, label in base}
    for label, notice, keys in licenses.TEMPLATES:
        n = notice.split()
        offsets = [next(k for k in range(len(n)) if n[k : k + len(p.split())] == p.split()) for p in keys]
        starts = [{i - o for i in at(p)} for p, o in zip(keys, offsets, strict=True)]
        if set.intersection(*starts):
            labels.add(label)
    return len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels))


def test_licences_equal_a_scan_of_all_places(spark):
    rng = np.random.default_rng(9)
    vocabulary = sorted({w for _, n, keys in licenses.TEMPLATES for w in n.split()})
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 300, 60)]
    for k in range(120):  # notices cut, doubled and spoilt
        _, notice, keys = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = notice.split()
        if k % 3 == 0:
            w[int(rng.integers(0, len(w)))] = "other"
        texts.append(" ".join([*rng.choice(vocabulary, 5), *w[int(rng.integers(0, 3)) :], *keys[:1], "x,y", *w]).upper())
    texts += [None, "", "the " * 30000 + "under the MIT license", "\u212a mit \u00e9 license", *texts[:3]]
    d = docs(spark, texts).withColumns({c: F.lit(1) for c in ("_words", "_present", "_joined", "labels", "n_words")})
    got = licenses.scan(d).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [brute_labels(t) for t in texts]


def brute_quality(rows, trusted):
    """n_words, base counts, llr and kept of each text, by plain loops."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def hashed(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS

    def grams(w):
        return [g for i, x in enumerate(w) for g in (hashed(x), hashed(x, w[i + 1] if i + 1 < len(w) else ""), hashed("~", x[-3:]))]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(split(t)))
        if i in trusted:
            target.update(grams(split(t)))
    n, m, out = sum(raw.values()), sum(target.values()), []
    weight = {b: round(1000 * (math.log((target[b] + 1) / (m + quality.BUCKETS)) - math.log((raw[b] + 1) / (n + quality.BUCKETS)))) if m else 0 for b in raw}
    for _, t in rows:
        w = split(t)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        llr = sum(weight[g] for g in grams(w)) / (3 * len(w) * 1000) if w else None
        out.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and (llr or 0.0) >= quality.THRESHOLD, None if llr is None else round(llr, 9)))
    return out


def quality_fixture(spark):
    rng = np.random.default_rng(12)
    good, bad = [f"good{i}" for i in range(12)], [f"junk{i}#" for i in range(12)]
    texts = [" ".join(rng.choice(good if k % 3 else bad, 40)) for k in range(60)]
    texts += ["a b c d e " * 4, "one\ntwo\none\n\nthree four five six seven eight nine ten", None, "", " \t\n", "word " * 3000, "\u00e9\u00a0x y z " * 3, texts[0]]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)] + [(None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    return list(enumerate(texts)), {k for k in range(40) if k % 3}, labels


def test_quality_equals_brute_force(spark):
    rows, trusted, labels = quality_fixture(spark)
    d = docs(spark, [t for _, t in rows]).withColumns({c: F.lit(1) for c in ("_words", "n_words", "llr", "kept", "_row", "_target")})
    got = quality.verdicts(d, labels).orderBy("doc_id").collect()
    want = brute_quality(rows, trusted)
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, None if r.llr is None else round(r.llr, 9)) for r in got] == want
    assert 20 < sum(w[6] for w in want) < 60
    kept = quality.keep(d, labels)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [i for (i, _), w in zip(rows, want, strict=True) if w[6]]


def test_pipeline_equals_stages_by_hand(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    corpus = pytest.importorskip("corpus_pipeline")
    rows, trusted, labels = quality_fixture(spark)
    texts = [t for _, t in rows]
    texts += [f"{texts[1]} scum idiot trash", f"{texts[2]} extra", f"{texts[4]} more words", texts[5].upper()]
    d = docs(spark, texts).withColumns({c: F.lit("kept") for c in ("_gone", "_row", "_score", "component_id", "piece")})
    toxic = labels.withColumn("toxic", F.lit(0)).where("doc_id is not null and doc_id <> 7")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    toxic.write.parquet(str(tmp_path / "labels.parquet"))
    want = [i for i, w in enumerate(brute_quality(list(enumerate(texts)), trusted - {7})) if w[6]]
    stage = corpus.quality_rules(spark, d, str(tmp_path))
    assert stage.columns == d.columns and sorted(r.doc_id for r in stage.collect()) == want
    model = toxicity.fit(stage, toxic)
    odds = {i: model["intercept"] + sum(model["weights"].get(f, 0.0) for f in {f for w in toxicity.words_of(texts[i]) for f in toxicity.features_of(w)}) for i in want}
    want = [i for i in want if odds[i] < 0]
    stage = corpus.toxicity_filter(spark, stage, str(tmp_path))
    assert stage.columns == d.columns and sorted(r.doc_id for r in stage.collect()) == want and len(texts) - 4 not in want
    _, low = brute_components([texts[i] for i in want])
    want = [i for k, i in enumerate(want) if low[k] == k]
    stage = corpus.ngram_jaccard(spark, stage, str(tmp_path))
    assert stage.columns == d.columns and sorted(r.doc_id for r in stage.collect()) == want
    final = corpus.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in final}) == want
    held = collections.defaultdict(list)
    for r in final:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and sorted(x)[0][0] == 0 for x in held.values())


def test_pipeline_stages_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    corpus = pytest.importorskip("corpus_pipeline")
    none = docs(spark, ["x"]).where("false")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2)], "a long, b long")
    assert sorted(map(tuple, components(e).collect())) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]


def test_empty_tables(spark):
    none = docs(spark, []).select(*[F.col(c) for c in DOCS.replace(" long", "").replace(" string", "").split(", ")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.scan(none).count() == quality.verdicts(none, labels).count() == jaccard.join(none).count() == sharding.layout(none).count() == 0
