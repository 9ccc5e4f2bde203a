"""BPE encoding and decoding of whole texts by a segment tree over adjacent pair ranks.

The leaves of the tree hold the ranks of the word's adjacent pairs (with the place in the low bits, so that the minimum
is the leftmost pair of lowest rank); the root is the next merge; a merge updates three leaves, each in logarithmic
time. The trees of many words stand as rows of one array and merge side by side; a long word has a tree of its own.
Words repeat, so every Python worker keeps a bounded table of the words that it has met.

Nulls and empty texts have no ids and decode to empty texts. Texts and words may be of any length. Repeated rows and
ids come back row by row, an empty table gives no rows, and columns beside doc_id and text play no part. The model is
read from a tokenizer file whose path is a parameter.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: White space as Unicode has it.
SPACE = "\t\n\v\f\r \x85\xa0                　"
#: str.split() also parts at these four, which are not Unicode white space.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: Words with what surrounds them, and bare words, kept for each Python worker.
KEPT_CHUNKS, KEPT_WORDS = 500_000, 250_000
NEVER = 1 << 62
#: Fixed value: the pattern that byte-level tokenizer files imply where they name none.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols of a word that merges beside others, words that do so at a time, ids of a batch that are decoded at a time.
BESIDE, AT_ONCE, DECODED = 64, 1 << 15, 1 << 25


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, then 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge the leftmost pair of lowest rank until no pair can be merged.

    ranks: rank of the pair left << 32 | right; made: the symbol that each rank makes. A leaf holds rank << bits | place.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    width, bits, rank_of = 1 << (n - 2).bit_length(), n.bit_length(), ranks.get
    tree = [NEVER] * (2 * width)
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = rank_of(left << 32 | right)
        if rank is not None:
            tree[width + i - 1] = rank << bits | i - 1
        left = right
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    out, following, before, mask = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1
    while (root := tree[1]) != NEVER:
        i = root & mask
        j = following[i]
        here = out[i] = made[root >> bits]
        out[j] = -1
        k = following[i] = following[j]
        h = before[i]
        new, old = NEVER, NEVER
        if k < n:
            before[k] = i
            rank = rank_of(here << 32 | out[k])
            if rank is not None:
                new = rank << bits | i
        if h >= 0:
            rank = rank_of(out[h] << 32 | here)
            if rank is not None:
                old = rank << bits | h
        for leaf, value in ((j, NEVER), (i, new), (h, old)):
            if leaf < 0 or leaf >= width:
                continue
            leaf += width
            while tree[leaf] != value:  # up to the root, or to where nothing changes
                tree[leaf] = value
                if leaf == 1:
                    break
                other = tree[leaf ^ 1]
                if other < value:
                    value = other
                leaf >>= 1
    return [x for x in out if x >= 0]


class Pairs:
    """Ranks of pairs, looked up for many pairs at a time."""

    def __init__(self, ranks: dict[int, int]):
        self.keys = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[k] for k in self.keys.tolist()], np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaf of each pair: rank and place, or NEVER where a side is missing (below 0) or no merge exists."""
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int64)
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at] << 8 | place, NEVER)


def merged_beside(symbols: np.ndarray, pairs: Pairs, made: np.ndarray) -> np.ndarray:
    """merged() for each row of symbols (words, filled up with -1): a row of the result holds its symbols, -1 between.

    A row of tree is a word's segment tree; each round takes every word's root, merges there and updates three leaves.
    """
    words, length = symbols.shape
    out = symbols.astype(np.int64)
    if length < 2 or not words:
        return out
    width = 1 << (length - 2).bit_length()
    tree = np.full((words, 2 * width), NEVER, np.int64)
    place = np.arange(length - 1)
    tree[:, width : width + length - 1] = pairs.leaves(out[:, :-1].ravel(), out[:, 1:].ravel(), np.tile(place, words)).reshape(words, -1)
    for level in range(width.bit_length() - 2, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    following = np.tile(np.arange(1, length + 1), (words, 1))
    before = np.tile(np.arange(-1, length), (words, 1))  # of the place after the last one too
    rows = np.arange(words)
    while True:
        root = tree[rows, 1]
        rows = rows[root != NEVER]
        if not len(rows):
            return out
        root = root[root != NEVER]
        i = root & 255
        j = following[rows, i]
        here = made[root >> 8]
        out[rows, i] = here
        out[rows, j] = -1
        k = following[rows, j]
        following[rows, i] = k
        before[rows, k] = i
        h = before[rows, i]
        next_one = np.where(k < length, out[rows, np.minimum(k, length - 1)], -1)
        new = pairs.leaves(here, next_one, i)
        old = pairs.leaves(np.where(h >= 0, out[rows, np.maximum(h, 0)], -1), here, np.maximum(h, 0))
        for leaf, value in ((j, NEVER), (i, new), (h, old)):
            has = (leaf >= 0) & (leaf < width)
            r, at = rows[has], leaf[has] + width
            tree[r, at] = value[has] if value is not NEVER else NEVER
            while at.size and at[0] > 1:  # all leaves are at one level
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])


class _Table(dict):
    """What has been made for a key, for a bounded number of keys: the first met stay, until misses call for a new start."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        self.add({key: value})
        return value

    def add(self, made: dict) -> None:
        room = max(0, self.most - len(self))
        self.missed += max(0, len(made) - room)
        if self.missed > 8 * self.most:
            self.clear()
            self.missed, room = 0, self.most
        self.update((k, v) for k, v in itertools.islice(made.items(), room) if len(k) <= BESIDE)


class Bpe:
    """A BPE model of a tokenizer file: byte-level pieces with or without word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path}: {model['type']} is not BPE")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.inner = [self.vocab[self.letters[b]] for b in range(256)]
        self.last = [self.vocab[self.letters[b] + self.suffix] for b in range(256)]
        self.joined_by_space = spec["decoder"] is None
        kinds = [x["type"] for x in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        split = next((x for x in parts if x["type"] == "Split"), None)
        space = "".join(f"\\u{ord(c):04x}" for c in SPACE)
        pattern = split["pattern"]["Regex"] if split else BYTE_PATTERN
        self.drops_space = bool(split)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
        self.cut_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words, self.chunks = _Table(self._word, KEPT_WORDS), _Table(self._chunk, KEPT_CHUNKS)
        self.letter_rows: pa.Array | None = None
        self.pairs, self.made_ids = Pairs(self.ranks), np.array(self.made, np.int64)

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return array("i", merged(symbols, self.ranks, self.made)).tobytes()

    def _cut(self, chunk: str) -> list[str]:
        if self.nfc:
            chunk = unicodedata.normalize("NFC", chunk)
        if self.lower:  # each character by itself, so a final sigma is as any other
            chunk = chunk.replace("Σ", "σ").lower()
        return self.pattern.findall(chunk)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._cut(chunk)))

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, merged beside words of about their length."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        made = {w: self._word(w) for w, r in zip(words, raw, strict=True) if len(r) > BESIDE}
        lengths = np.array([len(r) for r in raw])
        inner, last = np.array(self.inner), np.array(self.last)
        for longest in (4, 8, 16, 32, BESIDE):
            own = np.flatnonzero((lengths <= longest) & (lengths > (longest // 2 if longest > 4 else 0)))
            for part in (own[x : x + AT_ONCE] for x in range(0, len(own), AT_ONCE)):
                n = lengths[part]
                filled = np.arange(longest) < n[:, None]
                symbols = np.full((len(part), longest), -1, np.int64)
                symbols[filled] = inner[np.frombuffer(b"".join(raw[k] for k in part), np.uint8)]
                symbols[np.arange(len(part)), n - 1] = last[[raw[k][-1] for k in part]]
                out = merged_beside(symbols, self.pairs, self.made_ids)
                ids, ends = out[out >= 0].astype(np.int32).tobytes(), 4 * np.cumsum((out >= 0).sum(1))
                made |= {words[k]: ids[b - a : b] for k, a, b in zip(part.tolist(), (4 * (out >= 0).sum(1)).tolist(), ends.tolist(), strict=True)}
        return made

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks; new words of all of them merge side by side."""
        found = list(map(self.chunks.get, chunks))
        new = [k for k, x in enumerate(found) if x is None]
        cuts = [self._cut(chunks[k]) for k in new]
        words = self._new_words(list({w for cut in cuts for w in cut} - self.words.keys()))
        for k, cut in zip(new, cuts, strict=True):
            found[k] = b"".join([words[w] if w in words else self.words[w] for w in cut])
        self.words.add(words)
        self.chunks.add({chunks[k]: found[k] for k in new})
        return found

    def encode_rows(self, texts: pa.Array) -> pa.Array:
        """list<int32> of the ids of each text; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, "[\x1c-\x1f]")) if self.drops_space else pa.array([False] * len(texts), pa.bool_())
        for x in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, x)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(texts.filter(plain))
        chunks = pc.list_flatten(lists).dictionary_encode()
        made = self.chunk_ids(chunks.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in made], np.int64)
        each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.frombuffer(b"".join(made), np.int32)))
        ids = [each.take(chunks.indices).flatten().to_numpy()]
        ends = np.append(0, np.cumsum(size[chunks.indices.to_numpy()]))[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        odd = [np.frombuffer(self.encode_bytes(t), np.int32) for t in texts.filter(pc.invert(plain)).to_pylist()]
        n = np.zeros(len(texts), np.int64)
        n[is_plain], n[~is_plain] = np.diff(ends), [len(x) for x in odd]
        if odd:  # between the others, in the order of the texts
            parts, here = iter(odd), iter(np.split(ids[0], ends[1:-1]) if is_plain.any() else [])
            ids = [next(here if p else parts) for p in is_plain.tolist()]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(ids)))

    def decode_rows(self, rows: pa.Array) -> pa.Array:
        """The text of each list of ids; null gives an empty text."""
        if self.letter_rows is None:
            tokens = [self.tokens.get(i, "") for i in range(max(self.tokens, default=0) + 1)]
            self.letter_rows = pa.array(tokens) if self.joined_by_space else pa.array([t.encode() if t in self.special else bytes(map(self.bytes.__getitem__, t)) for t in tokens], pa.binary())
        out, ends = [], np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy()))
        flat, at = rows.flatten(), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED, "right")) - 1)
            tokens = self.letter_rows.take(flat[ends[at] : ends[to]])
            lists = pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), tokens)
            joined = pc.binary_join(lists, " " if self.joined_by_space else b"")
            out.append(joined if self.joined_by_space else pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string()))
            at = to
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def _plain(self, text: str) -> bytes:
        if self.drops_space and not NOT_SPACE.search(text):
            pieces = text.split()
        elif self.drops_space or "  " in text:  # a run of spaces is one piece of its own kind: no cuts inside it
            return self._chunk(text)
        else:  # a cut before a single space changes no piece, as the pattern takes the space with what follows
            first, *rest = text.split(" ")
            pieces = [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]
        return b"".join(map(self.chunks.__getitem__, pieces))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if not text:
            return b""
        if self.cut_special is None or not any(x in text for x in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            if m.start() > at:
                out.append(self._plain(text[at : m.start()]))
            out.append(array("i", [self.special[m[0]]]).tobytes())
            at = m.end()
        if at < len(text):
            out.append(self._plain(text[at:]))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        """The text of ids, special tokens included. Without a decoder in the file, tokens are joined by spaces; else
        their bytes are joined (what is not UTF-8 becomes U+FFFD)."""
        tokens = map(self.tokens.__getitem__, ids)
        if self.joined_by_space:
            return " ".join(tokens)
        raw = bytearray()
        for t in tokens:
            raw += t.encode() if t in self.special else bytes(map(self.bytes.__getitem__, t))
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One model for each Python worker and file."""
    return Bpe(path)


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
    """doc_id, ids and the text decoded from them, for every row of documents (repeated and null ids as they come)."""
    coded = docs.select("doc_id", encode(F.col("text"), path).alias("ids"))
    return coded.withColumn("decoded", decode(F.col("ids"), path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of roundtrip(): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return roundtrip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
