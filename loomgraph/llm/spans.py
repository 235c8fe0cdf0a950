"""Long exact spans shared between documents, by recompression.

Recompression names a text bottom up: in turn, short runs of one symbol and pairs of neighbouring symbols become a
symbol of the next level, until phrases are some ten characters long. A name is a hash of the names it stands for, so
equal phrases have equal names in every document without any exchange, and whether two neighbours merge depends on the
two alone (a bit of each name says whether it is a left or a right half; both must be short). A boundary between
phrases is therefore decided by the `reach` characters at either side of it, and two equal stretches of text agree on
all boundaries and phrases but those within reach of their ends.

Every window of `length` characters then has an anchor that its own text determines: of the phrases that begin at
least reach after its start and end at least reach before its end, the one of least name, the first of these on ties.
Neighbouring windows mostly share their anchor, so a document has one anchor in some ninety characters, and windows
are equal only if their anchors are. Spark then sifts in three grains, each a plain aggregate over 64-bit names:

1. the anchor's symbol with the text that decides it, which lies in all of its windows (`core`): anchors whose core
   occurs in one document only are done with, which are most;
2. the text of all windows of an anchor (`whole`): if another document has it too, all of these windows are shared;
3. what is left sits at the ends of shared stretches: blocks of windows, and then single windows, of one
   representative per distinct whole.

A result needs the core and the whole (or window) to agree: 64 bits made from the symbols' names tell cores apart, and 64
others, made from the characters, the texts with one core. Nothing pairs up the members of a group: each
grain keeps the least and the greatest document of a name, which differ exactly if the name is shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: The rounds of recompression: (kind, longest phrase that takes part, longest run that is merged).
ROUNDS = (("run", 1, 4), ("pair", 2, 0), ("pair", 3, 0), ("pair", 4, 0), ("run", 3, 6), ("pair", 5, 0), ("pair", 6, 0), ("pair", 8, 0), ("pair", 8, 0))


@dataclass(frozen=True)
class Grammar:
    """The rounds used: `reach` characters at either side of a boundary decide it, and no phrase is longer than `phrase`."""

    rounds: tuple[tuple[str, int, int], ...]

    @property
    def reach(self) -> int:
        return sum(longest + run for _, longest, run in self.rounds)

    @property
    def phrase(self) -> int:
        return max([1, *[run if kind == "run" else 2 * longest for kind, longest, run in self.rounds]])

    @staticmethod
    def of(length: int) -> Grammar:
        """All rounds, or as many of the first ones as leave room for an anchor in windows of this length."""
        for k in range(len(ROUNDS), 0, -1):
            if 2 * (g := Grammar(ROUNDS[:k])).reach + 2 * g.phrase <= length:
                return g
        return Grammar(())


#: Characters that are named at once; longer texts are cut into overlapping parts.
PART = 1 << 19
BLOCK = 16
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Texts:
    """Several texts end to end, as code points, with hashes of any stretch."""

    _powers = np.ones(1, _U)
    _inverses = np.ones(1, _U)

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        self.names = mix(self.codes.astype(_U) + _BASE)
        n = len(self.codes)
        if len(Texts._powers) <= n:
            size = max(n + 1, 2 * len(Texts._powers))
            Texts._powers = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE)]), dtype=_U)
            Texts._inverses = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _INVERSE)]), dtype=_U)
        self.sums = np.concatenate([[_U(0)], np.cumsum(self.names * Texts._powers[:n], dtype=_U)])

    def hashes(self, first: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of each stretch [first, end), as signed numbers."""
        return mix((self.sums[end] - self.sums[first]) * Texts._inverses[first] + _U(salt)).view(np.int64)


def recompress(texts: Texts, rounds: tuple[tuple[str, int, int], ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of the top level: positions, names, and index of the text."""
    n = len(texts.codes)
    pos, name = np.arange(n, dtype=np.int64), texts.names
    first = np.zeros(n, bool)
    first[texts.starts[texts.starts < n]] = True
    for turn, (kind, longest, most) in enumerate(rounds):
        size = np.diff(pos, append=n)
        short = size <= longest
        if kind == "run":
            follows = np.zeros(len(pos), bool)
            follows[1:] = (name[1:] == name[:-1]) & short[1:] & ~first[1:]
            heads = np.flatnonzero(~follows)
            count = np.diff(heads, append=len(pos))
            merge = (count > 1) & (count * size[heads] <= most)
            stay = ~follows | ~np.repeat(merge, count)
            name = name.copy()
            at = heads[merge]
            name[at] = mix(name[at] + count[merge].astype(_U) * _BASE)
        else:
            left = ((name >> _U(turn + 7)) & _U(1)).astype(bool)
            take = np.zeros(len(pos), bool)
            take[:-1] = left[:-1] & ~left[1:] & short[:-1] & short[1:] & ~first[1:]
            stay = np.ones(len(pos), bool)
            stay[1:] = ~take[:-1]
            at = np.flatnonzero(take)
            name = name.copy()
            name[at] = mix(name[at] * _BASE + mix(name[at + 1] + _U(turn + 1)))
        pos, name, first = pos[stay], name[stay], first[stay]
    return pos, name, np.searchsorted(texts.ends, pos, side="right")


def anchors(texts: Texts, length: int) -> tuple[np.ndarray, ...]:
    """Anchors as (text, first window, last window - first, anchor - first window, core, whole); windows within the text."""
    grammar = Grammar.of(length)
    reach, phrase = grammar.reach, grammar.phrase
    pos, name, text = recompress(texts, grammar.rounds)
    width = length - 2 * reach - phrase  # the anchor lies in [window + reach, window + reach + width]
    begin, end = texts.starts[text], texts.ends[text]
    low, high = np.maximum(pos - width, begin), np.minimum(pos, end)
    idx = np.arange(len(pos))
    active, step = idx, 1
    while len(active := active[active >= step]):
        other = active - step
        near = pos[other] >= low[active]
        active, other = active[near], other[near]
        stop = name[other] <= name[active]
        low[active[stop]] = pos[other[stop]] + 1
        active, step = active[~stop], step + 1
    active, step = idx, 1
    while len(active := active[active + step < len(pos)]):
        other = active + step
        near = (pos[other] <= pos[active] + width) & (pos[other] < end[active])
        active, other = active[near], other[near]
        stop = name[other] < name[active]
        high[active[stop]] = np.minimum(high[active[stop]], pos[other[stop]] - 1 - width)
        active, step = active[~stop], step + 1
    first = np.maximum(low - reach, begin)
    last = np.minimum(high - reach, end - length)
    ok = last >= first
    pos, name, text, first, last = pos[ok], name[ok], text[ok], first[ok], last[ok]
    around = texts.hashes(pos - reach, pos + reach + phrase, 1)
    core = mix(name * _BASE + around.view(_U)).view(np.int64)  # the anchor's symbol, and what decided it
    whole = texts.hashes(first, last + length, 2)
    return text, first - texts.starts[text], last - first, pos - first, core, whole


def _groups(ids: list, texts: list[str | None], length: int) -> Iterator[tuple[list[tuple[object, int]], list[str]]]:
    """Parts of texts, some PART characters at a time; the parts of a text overlap so that each window is in one."""
    owners, parts, size = [], [], 0
    for d, t in zip(ids, texts):
        if t is None or d is None or len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, PART):
            part = t[at : at + PART + length - 1]
            if parts and size + len(part) > PART:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append((d, at))
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def _find_anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "first", "span", "off", "core", "whole"]
        for b in batches:
            for owners, parts in _groups(b.column(0).to_pylist(), b.column(1).to_pylist(), length):
                text, first, span, off, core, whole = anchors(Texts(parts), length)
                doc = np.array([o[0] for o in owners], np.int64)[text]
                first = first + np.array([o[1] for o in owners], np.int64)[text]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first.astype(np.int32)), pa.array(span.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(core), pa.array(whole)], names=names)

    return docs.mapInArrow(run, "doc long, first int, span int, off int, core long, whole long")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """`wanted` (one row per doc and class) with the text of all windows of the class."""
    asked = wanted.groupBy(F.col("lo").alias("doc")).agg(F.collect_list(F.struct("core", "whole", "span", "off", "lo", "hi", "first")).alias("asked"))
    joined = docs.toDF("doc", "text").join(asked, "doc").select("text", F.explode("asked").alias("a"))
    return joined.select("a.*", F.substring("text", F.col("a.first") + 1, F.col("a.span").cast("int") + length).alias("piece"))


def _grain(pieces: DataFrame, length: int, block: int, only: bool) -> DataFrame:
    """Hashes of the blocks of `block` windows of every piece, numbered by their distance from the anchor.

    `only`: windows of the blocks in column `at` only (a list), else all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            span, off, piece = (b.column(c).to_numpy(zero_copy_only=False) if c != "piece" else b.column(c).to_pylist() for c in ("span", "off", "piece"))
            chosen = b.column("at").to_pylist() if only else None
            row, frm, to, rel = [], [], [], []
            texts = Texts(piece)
            for i in range(len(piece)):
                low, high, base = int(off[i]) - int(span[i]), int(off[i]), int(texts.starts[i]) + int(off[i])
                # a window at distance d from its anchor begins at base - d; block k holds the distances [k*block, (k+1)*block)
                for k in chosen[i] if only else range(low // block, high // block + 1):
                    a, z = max(low, k * block), min(high, (k + 1) * block - 1)
                    if only:
                        for d in range(a, z + 1):
                            row.append(i), frm.append(base - d), to.append(base - d + length), rel.append(d)
                    else:  # what all windows of the whole block share, whether or not the piece has all of them
                        row.append(i), frm.append(base - k * block), to.append(base - (k + 1) * block + 1 + length), rel.append(k)
            row, frm, to = (np.array(x, np.int64) for x in (row, frm, to))
            h = texts.hashes(frm, to, 3 + only)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in ("core", "whole", "span", "lo", "hi")), pa.array(rel, pa.int32()), pa.array(h)], names=["core", "whole", "span", "lo", "hi", "rel", "h"])

    return pieces.mapInArrow(run, "core long, whole long, span int, lo long, hi long, rel int, h long")


def _shared(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("core", "rel", "h").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most").drop("least", "most")


def shared_spans(documents: DataFrame, length: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal stretches covered by spans of at least `length` code points that occur in another document too.

    Columns `doc_id, span_start, span_len`, one row per stretch. Null and short texts have none; a document that is
    there twice under one id shares nothing with itself, exact copies under two ids share everything. Other columns
    aren't read. Any `length` from 2 will do; below 132 the symbols come from fewer rounds and are shorter.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    found = materialize(_find_anchors(docs, length))

    cores = found.groupBy("core").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("core")
    kept = materialize(found.join(cores, "core", "left_semi"))

    key = ["core", "whole", "span"]
    classes = materialize(
        kept.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min_by("first", F.struct("doc", "first")).alias("first"), F.min("off").alias("off"))
    )
    everywhere = classes.where("lo < hi").select(*key).withColumn("rels", F.lit(None).cast("array<struct<a:int,z:int>>"))

    open_cores = classes.groupBy("core").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.max(F.col("lo") == F.col("hi")).alias("open")).where("open and l < h").select("core")
    pieces = materialize(_cut(docs, classes.join(open_cores, "core", "left_semi"), length))
    blocks = materialize(_grain(pieces, length, BLOCK, False))
    hit = blocks.join(_shared(blocks), ["core", "rel", "h"], "left_semi").groupBy(*key).agg(F.sort_array(F.collect_set("rel")).alias("at"))
    windows = materialize(_grain(pieces.join(hit, key), length, BLOCK, True))
    single = windows.where("lo = hi").join(_shared(windows), ["core", "rel", "h"], "left_semi").select(*key, "rel").distinct()
    w = Window.partitionBy(*key).orderBy("rel")
    runs = single.withColumn("g", F.col("rel") - F.row_number().over(w)).groupBy(*key, "g").agg(F.min("rel").alias("a"), F.max("rel").alias("z"))
    some = runs.groupBy(*key).agg(F.collect_list(F.struct("a", "z")).alias("rels"))

    covered = kept.join(everywhere.unionByName(some), key)
    pieces_of = F.when(
        F.col("rels").isNull(), F.array(F.struct(F.col("first").alias("s"), (F.col("first") + F.col("span") + length).alias("e")))
    ).otherwise(F.transform("rels", lambda r: F.struct((F.col("first") + F.col("off") - r["z"]).alias("s"), (F.col("first") + F.col("off") - r["a"] + length).alias("e"))))
    return _islands(covered.select("doc", F.explode(pieces_of).alias("i")).select("doc", "i.s", "i.e"), doc_id)


def _islands(intervals: DataFrame, doc_id: str) -> DataFrame:
    """Overlapping and adjoining intervals of a document become one."""
    w = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    return (
        marked.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "g")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select(F.col("doc").alias(doc_id), F.col("s").cast("long").alias("span_start"), (F.col("e") - F.col("s")).cast("long").alias("span_len"))
    )


def shared_amounts(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its length, how much of it is shared, and in how many stretches; 0 for those that share nothing."""
    total = spans.groupBy(F.col(doc_id).alias("_doc")).agg(F.sum("span_len").alias("shared"), F.count(F.lit(1)).alias("n"))
    size = documents.select(doc_id, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    return size.join(total, F.col(doc_id) == F.col("_doc"), "left").select(
        doc_id, "n_chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"), F.coalesce("n", F.lit(0)).alias("n_spans")
    )
