"""Encoding with a byte-level pair vocabulary, JVM-free and without a tokenizer library.

A text is cut into words by the vocabulary's pattern. The pair merges of a word run over a segment tree: its leaves are
byte positions, a leaf holds the rank of the pair that starts there (or nothing) together with its position, and every
inner node the smaller of its two children, so the root is the leftmost pair of minimum rank. A merge changes three
leaves, each at logarithmic cost, so a word of n bytes takes n log n steps even if it is a whole text. Words repeat, so
every Python worker keeps the ids of the words it has met, within a bound.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words a worker remembers before its memory starts anew.
MEMORY_WORDS = 400_000
#: White space and contractions of the word pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE_ASCII = "\\t-\\r "
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_NOTHING = 1 << 62
_POSITION = (1 << 32) - 1

#: For texts of ASCII only.
_ASCII_WORDS = re.compile(rf"{CONTRACTIONS}| ?[A-Za-z]+| ?[0-9]+| ?[^{SPACE_ASCII}A-Za-z0-9]+|[{SPACE_ASCII}]+(?![^{SPACE_ASCII}])|[{SPACE_ASCII}]+")


def _unicode_words() -> re.Pattern[str]:
    """The word pattern for the standard library's engine: its word characters are the letters, numbers and _, its
    digits the decimal numbers; the other numbers are put in by code point."""
    others = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    runs: list[list[int]] = []
    for c in others:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    more = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return re.compile(rf"{CONTRACTIONS}| ?[^\W\d_{more}]+| ?[\d{more}]+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


_WORDS = _unicode_words()


def words(text: str) -> list[str]:
    """The words of a text, in order; together they are the text."""
    return _ASCII_WORDS.findall(text) if text.isascii() else _WORDS.findall(text)


class Encoder:
    """Ids of words by the ranks file at `path` (a line per token: base64 of its bytes, rank)."""

    def __init__(self, path: str = DEFAULT_RANKS) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Ids of one word by pair merges over a segment tree."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        tree = [_NOTHING] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        while (top := tree[1]) != _NOTHING:
            i = top & _POSITION
            j = after[i]
            part[i] += part[j]
            part[j] = None
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
            changed = [j, i]
            if before[i] >= 0:
                changed.append(before[i])
            for p in changed:
                value = _NOTHING
                if part[p] is not None and (q := after[p]) < n:
                    rank = ranks.get(part[p] + part[q])
                    if rank is not None:
                        value = rank << 32 | p
                k = size + p
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    low = a if a < b else b
                    if tree[k] == low:
                        break
                    tree[k] = low
                    k >>= 1
        return tuple(ranks[p] for p in part if p is not None)

    def _learn(self, found: list[str]) -> None:
        """Gives every word of `found` a place."""
        new = set(found).difference(self.place)
        if len(self.place) + len(new) > MEMORY_WORDS:
            self._forget()
            new = set(found)
        for w in new:
            ids = self.encode_bytes(w.encode("utf-8", "surrogatepass"))
            k, end = len(self.place), self.used + len(ids)
            if k == len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * k), np.resize(self.sizes, 2 * k)
            if end > len(self.values):
                self.values = np.resize(self.values, 2 * end)
            self.values[self.used : end] = ids
            self.place[w], self.starts[k], self.sizes[k], self.used = k, self.used, len(ids), end

    def _places(self, found: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        except KeyError:
            self._learn(found)
            return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (with the end of the last)."""
        parts, counts = [], np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            if t:
                at = self._places(words(t))
                sizes = self.sizes[at]
                ends = np.cumsum(sizes)
                n = counts[k + 1] = int(ends[-1])
                parts.append(self.values[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(n)])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.cumsum(counts)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens, whose strings are ordinary text; none for null or empty text."""
        return self.encode_many([text])[0].tolist()

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        at = self._places(words(text))  # may move the arrays
        return int(self.sizes[at].sum())


_encoders: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_RANKS) -> Encoder:
    """This process's encoder for a ranks file; a reused Python worker keeps it, with the words it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(df: DataFrame, text: str = "text", ranks: str = DEFAULT_RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `ids` (array<int>) for every row: null, empty and repeated texts included.

    One pass without a shuffle; texts travel to Python in Arrow batches and ids come back as one offset array and one
    value array per batch. Columns that aren't kept aren't read, so clashing names elsewhere don't matter.
    """
    picked = df.select(*keep, F.col(text).alias("_text"))
    schema = picked.drop("_text").schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            ids, starts = enc.encode_many(batch.column("_text").to_pylist())
            lists = pa.ListArray.from_arrays(starts.astype(np.int32), ids)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], names=[*keep, "ids"])

    return picked.mapInArrow(run, schema)


def count_column(df: DataFrame, text: str = "text", ranks: str = DEFAULT_RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and `n_tokens` for every row; null and empty texts have 0."""
    picked = df.select(*keep, F.col(text).alias("_text"))
    schema = picked.drop("_text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            sizes = pa.array([enc.count(t) for t in batch.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [sizes], names=[*keep, "n_tokens"])

    return picked.mapInArrow(run, schema)
