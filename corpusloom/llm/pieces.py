"""SentencePiece encoding and decoding of whole texts: merge-type pieces, encoded exactly by backtracking.

An Aho-Corasick automaton gives the longest piece that starts at each place. The encoder takes it if it may stand beside
the piece before it, else the next shorter prefix that is a piece; where none is left, the place is marked as failed in
a bitfield and the piece before it is shortened in its turn. Two pieces may stand side by side if merging their
characters again never joins across their border: both are played back by rank, their edges side by side.

Merges of one score go from the left on. A model may give one score to pieces of repeated spaces alone, as the last
merges of all; runs of spaces then merge from the left on, on a stack. No piece has a space after another character, so
texts are parted before spaces, at characters that stand in no longer piece, and after letters where no piece has
another character after a letter; parts repeat, so every Python worker keeps a bounded table of those that it has met. Characters without a piece become their bytes.

Nulls and empty texts have no ids and decode to empty texts. Texts and words may be of any length. Repeated rows and ids
come back row by row, an empty table gives no rows, and columns beside doc_id and text play no part. The model is read
from a file whose path is a parameter.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: What stands for a space in pieces, and what an unknown piece decodes to (fixed values of the format).
SPACE, UNKNOWN = "▁", " ⁇ "
#: Parts of texts and verdicts on pairs of pieces that a Python worker keeps; ids that are decoded at a time.
KEPT_PARTS, KEPT_PAIRS, DECODED = 500_000, 1_000_000, 1 << 25
#: Longer parts are not kept.
LONGEST = 64
#: What stands before the first piece.
START = 0xFFFFFFF
NEVER = float("inf")


class Kept(dict):
    """What has been made for a key; emptied when it holds most keys."""

    def __init__(self, make, most: int, size=None):
        super().__init__()
        self.make, self.most, self.size_of = make, most, size

    def __missing__(self, key):
        value = self.make(key)
        if self.size_of is None or self.size_of(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Pieces:
    """A merge-type model with byte fallback, a leading space added to each text and no other normalisation."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.text = {i: sp.id_to_piece(i) for i in ids if i not in special}
        self.id = {t: i for i, t in self.text.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.control = {i for i in ids if sp.is_control(i)}
        if len(self.bytes) < 256 or any(sp.is_unused(i) for i in ids):
            raise ValueError(f"{path}: models without bytes or with unused pieces are not read")
        long = {i: sp.get_score(i) for i, t in self.text.items() if len(t) > 1}
        self.rank = {i: -score for i, score in long.items()}
        within = {c for i in long for c in self.text[i]}
        ties = [i for i in long if not self.text[i].strip(SPACE)]
        worst = max((self.rank[i] for i in long if i not in set(ties)), default=-NEVER)
        apart = set(long) - set(ties)
        self.runs = {len(self.text[i]): i for i in ties}
        if not within <= self.id.keys() or any(SPACE in t[1:] for t in map(self.text.get, apart)) or len({self.rank[i] for i in apart}) < len(apart) or any(self.rank[i] <= worst for i in ties) or len({self.rank[i] for i in ties}) > 1:
            raise ValueError(f"{path}: pieces with inner spaces, equal scores or unknown characters are not read")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if len(t) == 1 or i in apart:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        inner = within - {SPACE}
        # where no piece goes on after a letter with another kind of character, a part ends with its letters
        ends = not any(a.isalpha() and not b.isalpha() for t in map(self.text.get, apart) for a, b in zip(t, t[1:]))
        letters, others = ("".join(map(re.escape, sorted(x))) for x in ({c for c in inner if ends and c.isalpha()}, {c for c in inner if not (ends and c.isalpha())}))
        others_, letters_ = f"[{others}]" if others else "(?!)", f"[{letters}]" if letters else "(?!)"
        self.cut = re.compile(f"{SPACE}+{others_}*{letters_}*|{others_}+{letters_}*|{letters_}+|[^{SPACE}{others}{letters}]", re.DOTALL)
        self.trees: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.size = [len(self.text.get(i, "")) for i in ids]
        self.shorter = Kept(self.prefix, len(self.text))
        self.pairs = Kept(lambda pair: self.beside(pair >> 32, pair & 0xFFFFFFFF) if pair >> 32 != START else self.tree(pair & 0xFFFFFFFF) is not None, KEPT_PAIRS)
        self.parts = Kept(self._part, KEPT_PARTS, len)
        self.words = Kept(lambda word: self._part(SPACE + word), KEPT_PARTS, len)
        surface = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | {i: bytes([b]) for b, i in self.bytes.items()} | dict.fromkeys(self.control, b"")
        self.surface = pa.array([surface.get(i, UNKNOWN.encode()) for i in ids], pa.binary())
        self.is_control = np.array([i in self.control for i in ids])
        self.spaced = np.array([self.text.get(i, "").startswith(SPACE) for i in ids])

    def tree(self, i: int) -> tuple[int, int] | None:
        """The two pieces that merge last into piece i; itself twice for a character, none where merging its characters
        doesn't lead to it."""
        if i not in self.trees:
            parts = [self.id[c] for c in self.text[i]]
            last = (i, i)
            while len(parts) > 1:
                ranks = [self.rank.get(self.id.get(self.text[a] + self.text[b], -1), NEVER) for a, b in zip(parts, parts[1:])]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] == NEVER:
                    last = None
                    break
                last = parts[k], parts[k + 1]
                parts[k : k + 2] = [self.id[self.text[last[0]] + self.text[last[1]]]]
                if any(self.rank.get(x, -NEVER) >= ranks[k] for x in last):
                    raise ValueError(f"piece {i} is made of a piece of a later rank")
            self.trees[i] = last
        return self.trees[i]

    def edge(self, i: int, side: int) -> list[int]:
        """The pieces that stand at the left (0) or right (1) edge of piece i while it is merged, the character first."""
        if i not in self.edges[side]:
            part = self.tree(i)[side]
            self.edges[side][i] = [i] if part == i else [*self.edge(part, side), i]
        return self.edges[side][i]

    def beside(self, a: int, b: int) -> bool:
        """Whether pieces a and b may stand side by side. Of merges of one rank the left one comes first."""
        if not self.tree(a) or not self.tree(b):
            return False
        left, right, x, y = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            end_a = self.rank[left[x + 1]] if x + 1 < len(left) else NEVER
            end_b = self.rank[right[y + 1]] if y + 1 < len(right) else NEVER
            across = self.rank.get(self.id.get(self.text[left[x]] + self.text[right[y]], -1), NEVER)
            if across < end_a and across <= end_b:
                return False
            if end_a == end_b == NEVER:
                return True
            if end_a <= end_b:
                x += 1
            else:
                y += 1

    def prefix(self, i: int) -> int:
        """The longest piece that is a shorter beginning of piece i, -1 if there is none."""
        t = self.text[i]
        return next((self.id[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.id), -1)

    def backtracked(self, s: str) -> list[int]:
        """The pieces of s, whose characters all are pieces."""
        whole = self.id.get(s)
        if whole is not None and self.tree(whole):
            return [whole]
        longest = [0] * len(s)
        for end, (i, n) in self.automaton.iter(s):
            longest[end - n + 1] = i  # ends grow, so the longest comes last
        failed: bytearray | None = None  # until a place fails
        out, last, at, stop, size, pairs, shorter = [], START, 0, len(s), self.size, self.pairs, self.shorter
        piece = longest[0]
        while at < stop:
            while piece >= 0:
                end = at + size[piece]
                if pairs[last << 32 | piece] and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(last)
                last, at = piece, end
                piece = longest[at] if at < stop else -1
            else:
                failed = failed or bytearray(stop // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece, last = last, out.pop()
                at -= size[piece]
        return [*out[1:], last]

    def spaces(self, n: int) -> list[int]:
        """The pieces of a run of n spaces: merges from the left on, on a stack of lengths."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.runs:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.runs.get(k, self.id[SPACE]) for k in sizes]

    def _part(self, part: str) -> bytes:
        rest = part.lstrip(SPACE)
        before = len(part) - len(rest)
        if not rest:
            ids = self.spaces(before)
        elif self.cut.fullmatch(part) is None:
            return b"".join(map(self.parts.__getitem__, self.cut.findall(part)))
        elif rest not in self.id and len(rest) == 1:
            ids = [*self.spaces(before), *(self.bytes[b] for b in rest.encode("utf-8", "surrogatepass"))]
        else:
            ids = self.backtracked(part[max(0, before - 1) :])
            if before > 1:  # all merges with the word come before those of spaces alone
                alone = ids[0] == self.id[SPACE]
                ids = self.spaces(before if alone else before - 1) + ids[alone:]
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or SPACE in text:
            return b"".join(map(self.parts.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def encode_rows(self, texts: pa.Array) -> pa.Array:
        found = [self.encode_bytes(t.as_py()) for t in texts]
        ends = np.append(0, np.cumsum([len(x) // 4 for x in found]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

    def decode_rows(self, rows: pa.Array) -> pa.Array:
        """The text of each list of ids; null gives an empty text."""
        size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
        ends, flat, out, at = np.append(0, np.cumsum(size)), rows.flatten(), [], 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED, "right")) - 1)
            ids = flat[ends[at] : ends[to]]
            lists = pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), self.surface.take(ids))
            numbers = ids.to_numpy()
            for raw, a, b in zip(pc.binary_join(lists, b"").to_pylist(), ends[at:to] - ends[at], ends[at + 1 : to + 1] - ends[at], strict=True):
                out.append(self._shown(raw, numbers[a:b]))
            at = to
        return pa.array(out, pa.string())

    def _shown(self, raw: bytes, ids: np.ndarray) -> str:
        # the space that was added goes with the first piece that isn't a control piece
        control = self.is_control[ids]
        first = next((i for i in ids if not self.is_control[i]), None)
        added = int(first is not None and self.spaced[first])
        if not control.any():
            return characters(raw[added:])
        runs = (b"".join(self.surface[int(i)].as_py() for i in run) for run in np.split(ids, np.flatnonzero(control)))
        shown = "".join(map(characters, runs))  # bytes on either side of a control piece make no character
        return shown[added:]


def characters(raw: bytes) -> str:
    """UTF-8 as text; each byte that starts no character is replaced by itself."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """One model for each Python worker and file."""
    return Pieces(path)


def encode(text: Column, path: str) -> Column:
    """array<int> of ids of each whole text (null: empty array)."""

    @arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return load(path).encode_rows(texts)

    return ids_of(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of ids (null: empty text)."""

    @arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        return load(path).decode_rows(rows)

    return text_of(ids)


def roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row of documents."""
    coded = docs.select("doc_id", encode(F.col("text"), path).alias("ids"))
    return coded.withColumn("decoded", decode(F.col("ids"), path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of roundtrip(): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return roundtrip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
