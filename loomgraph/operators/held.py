"""Searches from every vertex over a graph that each worker holds.

What is asked of all pairs of vertices has more rows than the graph, so that the graph is the small side: up to HELD edges
go to the workers once, as arrays, and nothing that a search has seen is written or shuffled. A task searches from many
sources at once, a bit of a word for each, over the part of the graph that these reach. `hold` gives None for larger
graphs and for ids that aren't plain values; these are searched by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import measured, release

#: Edges that a worker may hold; sources of a task, at most.
HELD, SOURCES = 1 << 23, 1024
#: Rows of the bits that are spread at once, and rows of a batch of results.
SPREAD, ROWS = 1 << 14, 1 << 19
_PLAIN = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType, T.DateType)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


class Part:
    """Edges among `n` vertices in order of their ends: `near[at[v] : at[v + 1]]` begin edges to v, `times` is how many each
    stands for (None: one)."""

    def __init__(self, at: np.ndarray, near: np.ndarray, times: np.ndarray | None = None) -> None:
        self.n, self.at, self.near, self.times = len(at) - 1, at, near, times
        self.met = np.flatnonzero(at[1:] > at[:-1])
        self._out: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same edges in order of their beginnings: `(at, far, edge)`."""
        if self._out is None:
            edge = np.argsort(self.near, kind="stable")
            far = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.at))[edge]
            self._out = np.r_[0, np.cumsum(np.bincount(self.near, minlength=self.n))], far, edge
        return self._out

    def step(self, values: np.ndarray, fold: np.ufunc) -> np.ndarray:
        """What the vertices get if each sends its value along its edges; 0 is nothing."""
        out = np.zeros(self.n, values.dtype)
        if not len(self.near):
            return out
        at, far, edge = self.out()
        on = np.flatnonzero(values)
        sizes = at[on + 1] - at[on]
        counts = fold is np.add and self.times is not None
        if sizes.sum() * 8 < len(self.near):
            i = _ranges(at[on], sizes)
            sent = np.repeat(values[on], sizes)
            fold.at(out, far[i], sent * self.times[edge[i]] if counts else sent)
        else:
            sent = values[self.near]
            out[self.met] = fold.reduceat(sent * self.times if counts else sent, self.at[self.met])
        return out

    def within(self, sources: np.ndarray, depth: int | None) -> tuple[np.ndarray | None, Part]:
        """The vertices that the sources reach, in order, and the part of them; None and all where that is about as much."""
        at, far, _ = self.out()
        seen = np.zeros(self.n, bool)
        seen[sources] = True
        front = sources
        while len(front) and depth != 0:
            to = far[_ranges(at[front], at[front + 1] - at[front])]
            fresh = np.zeros(self.n, bool)
            fresh[to] = True
            fresh &= ~seen
            seen |= fresh
            front = np.flatnonzero(fresh)
            depth = None if depth is None else depth - 1
        held = np.flatnonzero(seen)
        sizes = self.at[held + 1] - self.at[held]
        if sizes.sum() * 2 > len(self.near):
            return None, self
        i = _ranges(self.at[held], sizes)
        keep = seen[self.near[i]]
        row = np.repeat(np.arange(len(held)), sizes)[keep]
        place = np.cumsum(seen) - 1
        near = place[self.near[i[keep]]].astype(np.int32)
        return held, Part(np.r_[0, np.cumsum(np.bincount(row, minlength=len(held)))], near, None if self.times is None else self.times[i[keep]])


@dataclass
class Held:
    """A graph as arrays: `ids` of its vertices in order, and its edges. `kind`: the type of an id."""

    ids: pa.Array
    part: Part
    kind: str

    def numbers(self, ids: DataFrame) -> np.ndarray:
        """The places of some ids (column `id`) that are in the graph."""
        at = pc.index_in(ids.select("id").toArrow()["id"], value_set=self.ids)
        return np.sort(at.drop_null().to_numpy().astype(np.int64))


def hold(edges: DataFrame, vertices: DataFrame | None = None, undirected: bool = False, counted: bool = False) -> Held | None:
    """The graph of edges `src, dst` and of vertices `id` without any; None if workers can't hold it.

    `counted`: parallel edges count each, otherwise as one.
    """
    if not all(isinstance(edges.schema[c].dataType, _PLAIN) for c in ("src", "dst")) or edges.schema["src"].dataType != edges.schema["dst"].dataType:
        return None
    e, seen = measured(edges.select("src", "dst"), {"n": F.count(F.lit(1))})
    v, alone = (None, {"n": 0}) if vertices is None else measured(vertices.select("id"), {"n": F.count(F.lit(1))})
    if max(seen["n"], alone["n"]) > HELD:
        release(e, *([] if v is None else [v]))
        return None
    rows = e.toArrow()
    ends = [*rows["src"].chunks, *rows["dst"].chunks, *([] if v is None else v.toArrow()["id"].chunks)]
    release(e, *([] if v is None else [v]))
    ids = pc.unique(pa.chunked_array(ends, rows["src"].type))
    del ends
    ids = ids.take(pc.sort_indices(ids))
    if rows["src"].null_count or rows["dst"].null_count:
        rows = rows.filter(pc.and_(rows["src"].is_valid(), rows["dst"].is_valid()))
    # what is made here is as large as the graph: no more of it at a time than it takes
    src, dst = (pc.index_in(rows[c], value_set=ids).to_numpy() for c in ("src", "dst"))
    m, n = len(rows), max(len(ids), 1)
    del rows
    pa.default_memory_pool().release_unused()
    keys = np.empty(2 * m if undirected else m, np.int64)
    for part, end, begin in ((keys[:m], dst, src), (keys[m:], src, dst))[: 1 + undirected]:
        part[:] = end
        part *= n
        part += begin
    del src, dst
    keys.sort()
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    times = np.diff(np.r_[np.flatnonzero(new), len(keys)]) if counted and not new.all() else None
    if not new.all():
        keys = keys[new]
    at = np.searchsorted(keys, np.arange(len(ids) + 1, dtype=np.int64) * n)
    keys %= n
    return Held(ids, Part(at, keys.astype(np.int32), times), edges.schema["src"].dataType.simpleString())


def _by_batch(spark, held: Held, sources: np.ndarray | None, schema: str, run: Callable[[Held, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`run` over batches of sources (None: all), of vertices that are near in order."""
    n = len(held.ids) if sources is None else len(sources)
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = min(SOURCES, max(64, -(-n // tasks // 64) * 64))
    sent = spark.sparkContext.broadcast((held.ids, held.part.at, held.part.near, held.part.times, held.kind, sources))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, near, times, kind, chosen = sent.value
        graph = _cached(sent, lambda: Held(ids, Part(at, near, times), kind))
        for b in batches:
            for k in b.column(0).to_pylist():
                own = np.arange(k * size, min(n, (k + 1) * size))
                yield from run(graph, own if chosen is None else chosen[own])

    count = -(-n // size)
    return spark.range(0, count, 1, max(count, 1)).mapInArrow(of, schema)


_worker: dict[int, tuple[object, Held]] = {}


def _cached(sent, make: Callable[[], Held]) -> Held:
    """The graph that this worker made of what was sent; of the last one only."""
    value = sent.value
    if id(value) not in _worker:
        _worker.clear()
        _worker[id(value)] = value, make()
    return _worker[id(value)][1]


def _searched(graph: Held, sources: np.ndarray, depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
    """`(distance, 64 sources, vertices of the words, words)`, a bit for each source that is at this distance."""
    held, part = graph.part.within(sources, depth)
    start = sources if held is None else np.searchsorted(held, sources)
    for k in range(0, len(sources), 64):
        own = start[k : k + 64]
        front = np.zeros(part.n, np.uint64)
        front[own] = np.uint64(1) << np.arange(len(own), dtype=np.uint64)
        seen, far = front.copy(), 0
        while front.any():
            yield far, sources[k : k + 64], held, front
            if far == depth:
                break
            front = part.step(front, np.bitwise_or) & ~seen
            seen |= front
            far += 1


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pairs(spark, held: Held, sources: np.ndarray | None = None, depth: int | None = None, least: int = 0) -> DataFrame:
    """`source, id, dist` (int) of all pairs at distances of `least` to `depth`, made where they are read."""

    def run(graph: Held, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for far, some, held_, words in _searched(graph, own, depth):
            on = np.flatnonzero(words) if far >= least else np.empty(0, np.int64)
            for k in range(0, len(on), SPREAD):
                rows, source = np.nonzero(_bits(words[on[k : k + SPREAD]]))
                to = on[k : k + SPREAD][rows]
                yield pa.RecordBatch.from_arrays([graph.ids.take(pa.array(some[source])), graph.ids.take(pa.array(to if held_ is None else held_[to])), pa.array(np.full(len(to), far, np.int32))], ["source", "id", "dist"])

    return _by_batch(spark, held, sources, f"source {held.kind}, id {held.kind}, dist int", run)


def amounts(spark, held: Held, sources: np.ndarray | None = None, depth: int | None = None) -> DataFrame:
    """`source, dist, n`: how many vertices each source has at each distance, its own at 0."""

    def run(graph: Held, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for far, some, _, words in _searched(graph, own, depth):
            bits = _bits(words[np.flatnonzero(words)])
            n = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([graph.ids.take(pa.array(some[on])), pa.array(np.full(len(on), far, np.int32)), pa.array(n[on])], ["source", "dist", "n"])

    return _by_batch(spark, held, sources, f"source {held.kind}, dist int, n long", run)


def three_steps(spark, held: Held, sources: np.ndarray | None, simple: bool) -> DataFrame:
    """`a, b, n`: paths of three edges from a to b, without a vertex twice or else without an edge twice.

    Walks are counted step by step, and those that don't count are taken off: a walk over x and y may only come back to
    y = a, which is left out, to b = a, or as a, b, y, b; with an edge twice it is a, b, a, b, or has a loop twice.
    """

    def run(graph: Held, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        held_, part = graph.part.within(own, 3)
        start = own if held_ is None else np.searchsorted(held_, own)
        begin, end = part.near, np.repeat(np.arange(part.n), np.diff(part.at))
        times = np.ones(len(begin), np.int64) if part.times is None else part.times.astype(np.int64)
        loop = begin == end
        loops = np.zeros(part.n, np.int64)
        loops[end[loop]] = times[loop]
        if simple and loop.any():
            begin, end, times = begin[~loop], end[~loop], times[~loop]
            part = Part(np.r_[0, np.cumsum(np.bincount(end, minlength=part.n))], begin, None if part.times is None else times)
        at, far, edge = part.out()
        # the edges back: both orders are sorted by key
        keys, back = end * part.n + begin, begin.astype(np.int64) * part.n + end
        place = np.searchsorted(keys, back)
        there = np.minimum(place, max(len(keys) - 1, 0))
        returns = np.where(keys[there] == back, times[there], 0) if len(keys) else keys
        mutual = np.zeros(part.n, np.int64)
        np.add.at(mutual, begin, times * returns)
        names, numbers, counts, size = [], [], [], 0
        for source, a in zip(own, start):
            i = edge[at[a] : at[a + 1]]
            to, m, r = end[i], times[i], returns[i]
            c = np.zeros(part.n, np.int64)
            c[to] = m
            c = part.step(c, np.add)
            if simple:
                c[a] = 0
            c = part.step(c, np.add)
            if simple:
                c[to] -= m * (mutual[to] - r * m)
                c[a] = 0
            else:
                c[to] -= m * r + m * loops[a] + m * loops[to]
                c[a] += 2 * loops[a]
            b = np.flatnonzero(c)
            names.append(np.full(len(b), source))
            numbers.append(b if held_ is None else held_[b])
            counts.append(c[b])
            size += len(b)
            if size >= ROWS:
                yield _counted(graph, names, numbers, counts)
                names, numbers, counts, size = [], [], [], 0
        if size:
            yield _counted(graph, names, numbers, counts)

    return _by_batch(spark, held, sources, f"a {held.kind}, b {held.kind}, n long", run)


def _counted(graph: Held, names: list[np.ndarray], numbers: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (graph.ids.take(pa.array(np.concatenate(x))) for x in (names, numbers))
    return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate(counts))], ["a", "b", "n"])
