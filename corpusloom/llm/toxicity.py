"""Toxicity by weak supervision.

Voters are lexicons (a seed list, and words, stems and endings found among the training rows), patterns, the absence of
any lexicon word, and the marks that people gave, which are one noisy voter of many. A voter that does not fire abstains.
A generative label model starts from the agreement of the voters and estimates by expectation maximisation how often
each is right when it fires and, from what the classes leave unexplained, how the voters hang together; voters that say
the same count less. Its posterior labels train a linear classifier that scores every whole text.

Labels are read only for training rows, at most TRAIN_ROWS of them. Scores depend on the text alone: null and empty
texts get the score of a text without any feature; repeated rows score alike, a score of 0.5 counts as toxic, texts may
be of any length. Rows without labels and labels without rows play no part; of several labels of one document the
largest holds. Where the labelled rows give no lexicon, the seed list alone decides. An empty table gives no rows. scores() reads no
other columns, keep() passes them on under any name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Bound of the training sample: the labelled rows of smallest hash.
TRAIN_ROWS = 20_000
#: The least share of toxic rows among those with a lexicon feature.
PRECISE = 0.7
#: How often a voter is taken to be right at the start (the share of toxic rows where it fires): lexicons, patterns, no
#: lexicon word, a toxic mark, a clean mark; and for how many rows this guess counts.
START, GUESS = {"lexicon": 0.9, "pattern": 0.3, "none": 0.03, "marked": 0.8, "cleared": 0.03}, 2.0
#: Words of insult that start the label model.
SEED = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool jerk imbecile".split()
WORD = re.compile(r"[^\W\d_]{3,}")
LETTER = re.compile(r"[^\W\d_]")
#: Words kept with their features for each Python worker.
KEPT_WORDS = 300_000


def features_of(word: str) -> list[str]:
    """The word, its stems of 4 to 7 letters and its endings of 4 to 6 letters."""
    n = len(word)
    return [word, *(word[:k] + "-" for k in range(4, min(8, n))), *("-" + word[-k:] for k in range(4, min(7, n)))]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def patterns(text: str | None) -> list[bool]:
    """Pattern voters: shouting, repeated marks, address of a reader, symbols in words, a very short text."""
    text = text or ""
    letters = len(LETTER.findall(text))
    return [
        letters > 20 and sum(map(str.isupper, text)) > 0.5 * letters,
        "!!" in text or "??" in text,
        re.search(r"\byou(?:'re| are)\b", text, re.I) is not None,
        re.search(r"\w[*$#@]{2,}", text) is not None,
        len(text) < 80,
    ]


def in_fold(doc_id: Column) -> Column:
    """True for held-out rows: crc32 of the id as text leaves 0 by 5. A null id is not held out, nor ever trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text and label (0 or 1) of the training sample: no held-out rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~in_fold(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def candidates(train: DataFrame) -> list[str]:
    """The features that point to toxic texts beyond chance, by their log-likelihood ratio."""

    def count(batches):
        for rows in batches:
            seen, toxic = Counter(), Counter()
            for text, label in zip(rows["text"], rows["label"], strict=True):
                found = {f for w in words_of(text) for f in features_of(w)}
                seen.update(found)
                if label:
                    toxic.update(found)
            yield pd.DataFrame({"f": list(seen), "n": list(seen.values()), "t": [toxic[f] for f in seen]})

    total = train.agg(F.count("*"), F.sum("label")).first()
    n, t = total[0], total[1] or 0
    if not n or not t or n == t:
        return []
    sums = train.mapInPandas(count, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    base = t / n
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    ratio = log(F.col("t"), F.col("n") * base) + log(F.col("n") - F.col("t"), F.col("n") * (1 - base))
    # so far above chance that none of the features tried should get there by it
    tried = sums.where("n >= 3").count()
    good = sums.where((F.col("t") >= 3) & (F.col("t") > 2 * base * F.col("n")) & (F.col("t") >= PRECISE * F.col("n")) & (ratio > float(np.log(tried + 1) + 2)))
    return [r.f for r in good.orderBy(ratio.desc(), "f").collect()]  # of at most TRAIN_ROWS texts


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of a toxic label for each row of 0/1 votes (0 abstains), and the model: the share of toxic rows where
    each voter fires, the correlations of voters within a class, and the share of its evidence that each voter keeps.

    start: what that share is taken to be before the first round."""
    logit = lambda p: np.log(p / (1 - p))
    votes = np.asarray(votes, np.float32)
    alone = (votes.T @ votes).astype(float)  # how often two voters fire together
    fired, right, keep, post = votes.sum(0), start.astype(float), np.ones(votes.shape[1]), None
    prior = float(np.clip(((votes @ right) / np.maximum(votes.sum(1), 1)).mean(), 0.01, 0.5))
    together = np.eye(votes.shape[1])
    for turn in range(rounds):
        odds = logit(prior) + votes @ (keep * (logit(right) - logit(prior)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        settled, post = post is not None and np.abs(new - post).max() < 1e-4, new
        if settled:
            break
        prior = float(np.clip(post.mean(), 1e-3, 0.9))
        right = np.clip((post @ votes + GUESS * start) / (fired + GUESS), 1e-3, 1 - 1e-3)
        if turn < 3:  # what a voter's vote leaves unexplained by the class; correlated remainders are the same evidence twice
            # of the table of remainders only its products are needed: it would be as large as the votes again
            on, off = post @ votes, (1 - post) @ votes
            one, two = on / max(post.sum(), 1e-9), off / max((1 - post).sum(), 1e-9)
            both = float(post @ (1 - post))
            left = alone - np.outer(on, one) - np.outer(one, on) - np.outer(off, two) - np.outer(two, off)
            left += float(post @ post) * np.outer(one, one) + both * (np.outer(one, two) + np.outer(two, one)) + float((1 - post) @ (1 - post)) * np.outer(two, two)
            scale = np.sqrt(np.maximum(np.diag(left), 0)) + 1e-6
            together = left / np.outer(scale, scale)
            alike = np.clip(together, 0, 1)
            alike[alike < 0.2] = 0
            np.fill_diagonal(alike, 1)
            keep = 1 / alike.sum(0)
    return post, {"right": right, "correlation": together, "keep": keep, "prior": np.array(prior)}


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull * w
        bend = ((x * (p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ x).astype(float) + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> dict:
    """The classifier: weights of features and the intercept."""
    from corpusloom.llm.common import materialise

    train = materialise(training_rows(docs, labels, most), "toxic-training")
    names = candidates(train)
    if not names:
        return {"weights": dict.fromkeys(SEED, 4.0), "intercept": -2.0}
    place = {f: i for i, f in enumerate(names)}

    def hits(batches):
        for rows in batches:
            found = [sorted({place[f] for w in words_of(t) for f in features_of(w) if f in place}) for t in rows["text"]]
            signs = [patterns(t) + [not words_of(t).isdisjoint(SEED)] for t in rows["text"]]
            yield pd.DataFrame({"label": rows["label"], "found": found, "signs": signs})

    rows = train.mapInPandas(hits, "label int, found array<int>, signs array<boolean>").collect()
    x = np.zeros((len(rows), len(names)), np.uint8)
    for i, r in enumerate(rows):
        x[i, r.found] = 1
    # features that stand in the same rows are one voter
    _, firsts, voter = np.unique(np.packbits(x, axis=0), axis=1, return_index=True, return_inverse=True)
    x, shared = x[:, firsts].astype(np.float32), np.bincount(voter.ravel())
    marked = np.array([r.label for r in rows], np.float32)[:, None]
    votes = np.hstack([x, np.array([r.signs for r in rows], np.float32), 1 - x.max(1, keepdims=True), marked, 1 - marked])
    kinds = ["lexicon"] * x.shape[1] + ["pattern"] * (len(rows[0].signs) - 1) + ["lexicon", "none", "marked", "cleared"]
    post, _ = label_model(votes, np.array([START[k] for k in kinds]))
    del rows, votes
    w = linear(x, post)
    each = w[:-1][voter.ravel()] / shared[voter.ravel()]
    return {"weights": {f: float(v) for f, v in zip(names, each, strict=True) if abs(v) > 1e-9}, "intercept": float(w[-1])}


def score(text: Column, model: dict) -> Column:
    """The probability that the text is toxic."""
    weights, intercept = model["weights"], model["intercept"]

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        met = _met.setdefault(id(weights), {})
        out = []
        for text in texts.to_pylist():
            found: set[str] = set()
            for w in words_of(text):
                got = met.get(w)
                if got is None:
                    got = tuple(f for f in features_of(w) if f in weights)
                    if len(met) < KEPT_WORDS:
                        met[w] = got
                if got:
                    found.update(got)
            odds = intercept + sum(weights[f] for f in sorted(found))
            out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, odds)))))
        return pa.array(out, pa.float64())

    _met: dict[int, dict] = {}
    return scored(text)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    rows = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), score(F.col("text"), fit(docs, labels)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns they came with."""
    whole = docs.select(F.struct("*").alias("_row"), "text").withColumn("_score", score(F.col("text"), fit(docs, labels)))
    return whole.where("_score < 0.5").select("_row.*")
