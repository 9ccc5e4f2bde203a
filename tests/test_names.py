from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import names


def plain(asked, known, k, least):
    out = {}
    for x in asked:
        rows = sorted((-(1.0 if x == y else SequenceMatcher(None, x, y).ratio()), a) for y, a in zip(known["name"], known["account"], strict=True))
        out[x] = [(a, -s) for s, a in rows[:k] if -s >= least]
    return out


@pytest.mark.parametrize("alphabet, longest, k, least", [("ab", 5, 3, 0.5), ("0123456789", 12, 5, 0.5), ("abc01", 70, 1, 0.8), ("abcdefghijklmnopqrstuvwxyz", 230, 5, 0.3)])
def test_nearest_names_equal_all_pairs(monkeypatch, alphabet, longest, k, least):
    """Empty names, names beyond the width of the bound and beyond the ratio's rule for long ones among them."""
    monkeypatch.setattr(names, "STEPS", 1000)
    rng = random.Random(longest)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    known = pd.DataFrame([(word(longest), f"a{i}") for i in range(200)], columns=["name", "account"])
    some = rng.sample(known["name"].tolist(), 20)
    asked = sorted({word(longest) for _ in range(10)} | {x[: len(x) // 2] + word(3) + x[len(x) // 2 :] for x in some} | set(some[:5]) | {""})
    want, got = plain(asked, known, k, least), {}
    for x, a, s in names.best_of_block(asked, np.full(len(asked), least), known, k, least):
        got.setdefault(x, []).append((a, s))
    assert got == {x: rows for x, rows in want.items() if rows}


def test_numbered_names_are_not_compared_with_all(monkeypatch):
    """Names that differ in their numbers alone are all near each other by their letters."""
    known = pd.DataFrame([(f"customer{i:09d}", f"Customer#{i:09d}") for i in range(20_000)], columns=["name", "account"])
    asked = [f"supplier{i:09d}" for i in range(0, 20_000, 400)]
    compared = []

    class Counted(SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(names, "SequenceMatcher", Counted)
    got = list(names.best_of_block(asked, np.full(len(asked), 0.5), known, 5, 0.5))
    assert len(got) == 5 * len(asked) and len(compared) < 100 * len(asked)


def test_names_out_of_reach():
    known = pd.DataFrame({"name": ["aaa", "aab"], "account": ["p", "q"]})
    assert list(names.best_of_block(["zzz", "yy"], np.full(2, 0.5), known, 5, 0.5)) == []
