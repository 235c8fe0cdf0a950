"""Vertex-centric algorithms as DataFrame supersteps.

Edges are `src, dst, w` and vertices `id`; results are `id` and values. A superstep is one join and one aggregate.
State is written to the shared folder every round, so a loop's lineage stays one round long; the state before it is
deleted then. Edges are written once in buckets by source and states in buckets by id, as many as shuffles have
partitions, so a round shuffles its messages only. What decides convergence is measured while the state is written.
Undirected algorithms use `both(edges)`. Ties go to the smaller id. An empty graph gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Grown, bucketed, materialize, measured, release
from . import held


def both(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Undirected simple edges, in both directions; of parallel edges the lightest."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    out = edges.select("src", "dst", "w").unionByName(back).groupBy("src", "dst").agg(F.min("w").alias("w"))
    return out if loops else out.where("src <> dst")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def _frames(edges: DataFrame, vertices: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    e = bucketed(edges.select("src", "dst", F.col("w").cast("double").alias("w")), "src")
    return e, bucketed((ends(e) if vertices is None else vertices.select("id")).distinct(), "id")


# -- Pregel ------------------------------------------------------------------------------------------------------
def pregel(edges: DataFrame, state: DataFrame, message: dict[str, Column], combine: dict[str, Callable[[Column], Column]], update: dict[str, Column], rounds: int, changed: Column | None = None, active: bool = False, aggregators: dict[str, Column] | None = None) -> DataFrame:
    """Generic supersteps over `state` (`id` and values).

    A message (name -> expression over the source's values, prefixed s_, and the edge's w) goes along every edge,
    `combine` folds the messages of a vertex, `update` gives its new values from its old ones and the messages (null
    where none came) and the `aggregators` (name -> aggregate over the state before the round, prefixed g_). Ends when
    `changed`, over old values prefixed old_, holds nowhere. `active`: only changed vertices send.
    """
    values = [c for c in state.columns if c != "id"]
    edges = bucketed(edges, "src")
    state = bucketed(state.withColumn("_on", F.lit(True)), "id")
    for _ in range(rounds):
        senders = state.where("_on") if active else state
        sent = senders.select(F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in values]).join(edges, "src")
        got = sent.select("dst", *[x.alias(k) for k, x in message.items()]).groupBy(F.col("dst").alias("id")).agg(*[combine[k](F.col(k)).alias(k) for k in message])
        joined = state.join(got, "id", "left")
        if aggregators:
            seen = state.agg(*[x.alias(k) for k, x in aggregators.items()]).first()
            joined = joined.withColumns({f"g_{k}": F.lit(seen[k]) for k in aggregators})
        new = joined.select("id", *[F.col(c).alias(f"old_{c}") for c in values], *[update.get(c, F.col(c)).alias(c) for c in values])
        on = changed if changed is not None else F.lit(True)
        state, seen = measured(new.withColumn("_on", F.coalesce(on, F.lit(False))).select("id", *values, "_on"), {"on": F.count_if(F.col("_on"))}, "id", state)
        if changed is not None and not seen["on"]:
            break
    return state.select("id", *values)


# -- ranking -----------------------------------------------------------------------------------------------------
def pagerank(edges: DataFrame, vertices: DataFrame | None = None, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """`id, rank`: ranks from 1/N, dangling mass spread evenly, until the change sums to less than tol * N."""
    e, v = _frames(edges, vertices)
    n = v.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    flow = materialize(e.select("src", "dst").join(degree, "src"), "src", e)
    values = {"lost": F.sum(F.when(F.col("sink"), F.col("rank"))), "change": F.sum("change")}
    begin = v.join(flow.select(F.col("src").alias("id"), "deg").distinct(), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.col("deg").isNull().alias("sink"), F.lit(0.0).alias("change"))
    state, seen = measured(begin, values, "id")
    for _ in range(max_iter):
        lost = seen["lost"] or 0.0
        got = flow.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("m"))
        rank = alpha * F.coalesce("m", F.lit(0.0)) + (1 - alpha) / n + alpha * lost / n
        state, seen = measured(state.join(got, "id", "left").select("id", rank.alias("rank"), "sink", F.abs(rank - F.col("rank")).alias("change")), values, "id", state)
        if seen["change"] < tol * n:
            break
    return state.select("id", "rank")


def pagerank_fixed(edges: DataFrame, vertices: DataFrame | None = None, delta: float = 0.85, max_round: int = 10) -> DataFrame:
    """`id, rank` after fixed rounds; a vertex without out-edges keeps delta times its own rank instead of spreading it."""
    e, v = _frames(edges, vertices)
    n = max(v.count(), 1)
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    flow = materialize(e.select("src", "dst").join(degree, "src"), "src", e)
    state = materialize(v.join(flow.select(F.col("src").alias("id"), "deg").distinct(), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.col("deg").isNull().alias("sink")), "id")
    for _ in range(max_round):
        got = flow.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("m"))
        own = F.when(F.col("sink"), delta * F.col("rank")).otherwise(0.0)
        state = materialize(state.join(got, "id", "left").select("id", ((1 - delta) / n + delta * F.coalesce("m", F.lit(0.0)) + own).alias("rank"), "sink"), "id", state)
    return state.select("id", "rank")


def articlerank(edges: DataFrame, vertices: DataFrame | None = None, delta: float = 0.85, max_round: int = 10) -> DataFrame:
    """`id, rank`: like PageRank from 0, where a source's value is divided by its degree plus the average degree."""
    e, v = _frames(edges, vertices)
    n = max(v.count(), 1)
    average = e.count() / n
    flow = materialize(e.select("src", "dst").join(e.groupBy("src").agg(F.count(F.lit(1)).alias("deg")), "src"), "src", e)
    state = materialize(v.select("id", F.lit(0.0).alias("rank")), "id")
    for _ in range(max_round):
        got = flow.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / (F.col("deg") + average)).alias("m"))
        state = materialize(state.join(got, "id", "left").select("id", ((1 - delta) + delta * F.coalesce("m", F.lit(0.0))).alias("rank")), "id", state)
    return state


def personalized_pagerank(edges: DataFrame, source: object, vertices: DataFrame | None = None, max_round: int = 10) -> DataFrame:
    """`id, rank`: half of every step restarts at the source; degrees are undirected."""
    e, v = _frames(both(edges), vertices)
    flow = materialize(e.select("src", "dst").join(e.groupBy("src").agg(F.count(F.lit(1)).alias("deg")), "src"), "src", e)
    start = F.when(F.col("id") == F.lit(source), 1.0).otherwise(0.0)
    state = materialize(v.select("id", start.alias("rank")), "id")
    for _ in range(max_round):
        got = flow.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("m"))
        state = materialize(state.join(got, "id", "left").select("id", (0.5 * start + 0.5 * F.coalesce("m", F.lit(0.0))).alias("rank")), "id", state)
    return state


def hits(edges: DataFrame, vertices: DataFrame | None = None, tolerance: float = 0.01, max_round: int = 100, normalized: bool = True, norm: str = "max") -> DataFrame:
    """`id, hub, auth`: authorities from hubs, then hubs from authorities, each divided by the maximum (or the L2 norm)."""
    e, v = _frames(edges, vertices)
    n = v.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("auth"))
    back = bucketed(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src")
    state = materialize(v.select("id", F.lit(1.0 / n).alias("hub"), F.lit(0.0).alias("auth")), "id")
    size = (lambda c: F.max(c)) if norm == "max" else (lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))))
    for _ in range(max_round):
        a = e.join(state.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        a, seen = measured(v.join(a, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a")), {"top": size("a")}, "id")
        top = seen["top"] or 1.0
        h = back.join(a.select(F.col("id").alias("src"), (F.col("a") / top).alias("a")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("a").alias("h"))
        h, seen = measured(a.select("id", (F.col("a") / top).alias("auth")).join(h, "id", "left").select("id", "auth", F.coalesce("h", F.lit(0.0)).alias("h")), {"top": size("h")}, "id", a)
        top = seen["top"] or 1.0
        new = h.join(state.select("id", F.col("hub").alias("old")), "id").select("id", (F.col("h") / top).alias("hub"), "auth", F.abs(F.col("h") / top - F.col("old")).alias("d"))
        state, seen = measured(new, {"d": F.sum("d")}, "id", [state, h])
        if seen["d"] <= tolerance:
            break
    if normalized:
        s = state.agg(F.sum("hub").alias("h"), F.sum("auth").alias("a")).first()
        return state.select("id", (F.col("hub") / (s.h or 1.0)).alias("hub"), (F.col("auth") / (s.a or 1.0)).alias("auth"))
    return state.select("id", "hub", "auth")


# -- centrality --------------------------------------------------------------------------------------------------
def degree_centrality(edges: DataFrame, vertices: DataFrame | None = None, centrality_type: str = "both") -> DataFrame:
    """`id, centrality`: in, out or both degrees over n - 1."""
    e, v = edges, (ends(edges) if vertices is None else vertices.select("id").distinct())
    n = v.count()
    cols = {"in": ["dst"], "out": ["src"], "both": ["src", "dst"]}[centrality_type]
    hits_ = e.select(F.explode(F.array(*cols)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return v.join(hits_, "id", "left").select("id", (F.coalesce("d", F.lit(0)) / F.lit(float(max(n - 1, 1)))).alias("centrality"))


def eigenvector_centrality(edges: DataFrame, vertices: DataFrame | None = None, tolerance: float = 1e-6, max_round: int = 100) -> DataFrame:
    """`id, centrality`: x + A x by incoming edges, divided by its L2 norm, until the change is below n * tolerance."""
    e, v = _frames(edges, vertices)
    n = max(v.count(), 1)
    state = materialize(v.select("id", F.lit(1.0 / n).alias("x")), "id")
    for _ in range(max_round):
        got = e.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("m"))
        raw, seen = measured(state.join(got, "id", "left").select("id", F.col("x").alias("old"), (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("y")), {"norm": F.sqrt(F.sum(F.col("y") * F.col("y")))}, "id", state)
        norm = seen["norm"] or 1.0
        new = raw.select("id", (F.col("y") / norm).alias("x"), F.abs(F.col("y") / norm - F.col("old")).alias("d"))
        state, seen = measured(new, {"d": F.sum("d")}, "id", raw)
        if (seen["d"] or 0.0) < n * tolerance:
            break
    return state.select("id", F.col("x").alias("centrality"))


def katz_centrality(edges: DataFrame, vertices: DataFrame | None = None, alpha: float = 0.1, beta: float = 1.0, tolerance: float = 1e-6, max_round: int = 100, normalized: bool = True, degree_threshold: int = 1_000_000_000) -> DataFrame:
    """`id, centrality`: alpha A x + beta from 0, until the change is below n * tolerance; L2 normalised at the end.

    Vertices with more incoming edges than the threshold take no messages."""
    e, v = _frames(edges, vertices)
    if degree_threshold < 1_000_000_000:
        small = e.groupBy("dst").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= degree_threshold)
        e = materialize(e.join(small, "dst", "left_semi"), "src", e)
    n = max(v.count(), 1)
    state = materialize(v.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("d")), "id")
    for _ in range(max_round):
        got = e.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("m"))
        y = alpha * F.coalesce("m", F.lit(0.0)) + beta
        state, seen = measured(state.join(got, "id", "left").select("id", y.alias("x"), F.abs(y - F.col("x")).alias("d")), {"d": F.sum("d")}, "id", state)
        if (seen["d"] or 0.0) < n * tolerance:
            break
    norm = (state.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0) if normalized else 1.0
    return state.select("id", (F.col("x") / norm).alias("centrality"))


def _multi_source(edges: DataFrame, sources: DataFrame, weighted: bool, rounds: int = 1_000_000) -> DataFrame:
    """`source, id, dist` from every source (column `id`), by frontier.

    Without weights a pair is final when it is first reached: layers are written once and never touched again. With
    weights a layer holds the pairs that improved; those that a later layer improved are superseded by it.
    """
    e = bucketed(edges.select("src", "dst", (F.col("w") if weighted else F.lit(1.0)).alias("w")), "src")
    front = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist")).distinct())
    known = Grown(front)
    for _ in range(rounds):
        step = front.select("source", F.col("id").alias("src"), "dist").join(e, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        if weighted:
            old = known.rows().select("source", "id", F.col("dist").alias("old"))
            new = step.join(old, ["source", "id"], "left").groupBy("source", "id", "dist").agg(F.min("old").alias("old")).where("old is null or dist < old").drop("old")
        else:
            new = step.join(known.rows().select("source", "id"), ["source", "id"], "left_anti")
        front, seen = measured(new, {"n": F.count(F.lit(1))})
        if not seen["n"]:
            break
        known.add(front)
    release(e)
    return known.rows().groupBy("source", "id").agg(F.min("dist").alias("dist")) if weighted else known.rows()


def _all_sources(edges: DataFrame, vertices: DataFrame | None, weighted: bool = False) -> DataFrame:
    """`source, id, dist` from every vertex: over a graph that workers hold, else by joins."""
    graph = None if weighted else held.hold(edges, vertices)
    if graph is None:
        e, v = _frames(edges, vertices)
        return _multi_source(e, v, weighted)
    sources = None if vertices is None else graph.numbers(vertices)
    return held.pairs(edges.sparkSession, graph, sources).withColumn("dist", F.col("dist").cast("double"))


def _amounts(edges: DataFrame, vertices: DataFrame | None = None, weighted: bool = False, undirected: bool = False) -> DataFrame:
    """`source, dist, n`: how many vertices are at each distance from every vertex."""
    graph = None if weighted else held.hold(edges, vertices, undirected)
    if graph is None:
        e, v = _frames(both(edges) if undirected else edges, vertices)
        return _multi_source(e, v, weighted).groupBy("source", "dist").agg(F.count(F.lit(1)).alias("n"))
    return held.amounts(edges.sparkSession, graph, None if vertices is None else graph.numbers(vertices))


def closeness_centrality(edges: DataFrame, vertices: DataFrame | None = None, wf_improved: bool = True, weighted: bool = False) -> DataFrame:
    """`id, centrality`: reached vertices over their distances along incoming edges, scaled by the reached share."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    d = materialize(_amounts(back, vertices, weighted).groupBy(F.col("source").alias("id")).agg(F.sum(F.col("dist") * F.col("n")).alias("s"), F.sum("n").alias("k")))
    n = d.count()
    c = F.when(F.col("s") > 0, (F.col("k") - 1) / F.col("s")).otherwise(0.0)
    if wf_improved and n > 1:
        c = c * (F.col("k") - 1) / F.lit(float(n - 1))
    return d.select("id", c.alias("centrality"))


def harmonic_centrality(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id, centrality`: sum of 1 / distance from every other vertex (exact; no sampling of sources)."""
    if vertices is None:  # it is as far back
        return _amounts(edges, undirected=True).groupBy(F.col("source").alias("id")).agg(F.sum(F.when(F.col("dist") > 0, F.col("n") / F.col("dist")).otherwise(0.0)).alias("centrality"))
    return _all_sources(both(edges), vertices).groupBy("id").agg(F.sum(F.when(F.col("dist") > 0, 1 / F.col("dist")).otherwise(0.0)).alias("centrality"))


def betweenness_centrality(edges: DataFrame, vertices: DataFrame | None = None, sources: DataFrame | None = None, normalized: bool = True, directed: bool = True) -> DataFrame:
    """`id, centrality`, by path counts forward and dependencies backward, all sources at once and level by level."""
    e, v = _frames(edges.groupBy("src", "dst").agg(F.min("w").alias("w")) if directed else both(edges), vertices)
    n = v.count()
    level = materialize((v if sources is None else sources.select("id")).select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma"), F.lit(0).alias("d")))
    levels, seen = [level], level.select("source", "id")
    while True:
        step = level.select("source", F.col("id").alias("src"), "sigma").join(e.select("src", "dst"), "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = materialize(step.join(seen, ["source", "id"], "left_anti").withColumn("d", F.lit(len(levels))))
        if level.isEmpty():
            break
        levels.append(level)
        seen = materialize(seen.unionByName(level.select("source", "id")))
    delta = None
    parts = []
    for k in range(len(levels) - 1, 0, -1):
        far = levels[k] if delta is None else levels[k].join(delta, ["source", "id"], "left")
        dep = F.lit(0.0) if delta is None else F.coalesce("delta", F.lit(0.0))
        far = far.select("source", F.col("id").alias("dst"), ((1.0 + dep) / F.col("sigma")).alias("c"), dep.alias("own"))
        far = materialize(far)
        parts.append(far.select(F.col("dst").alias("id"), F.col("own").alias("x")))
        up = far.join(e.select("src", "dst"), "dst").select("source", F.col("src").alias("id"), "c").join(levels[k - 1], ["source", "id"])
        delta = materialize(up.groupBy("source", "id").agg(F.sum(F.col("sigma") * F.col("c")).alias("delta")))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else (1.0 if directed else 0.5)
    if not parts:
        return v.select("id", F.lit(0.0).alias("centrality"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    total = total.groupBy("id").agg(F.sum("x").alias("x"))
    return v.join(total, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) * scale).alias("centrality"))


def voterank(edges: DataFrame, num_of_nodes: int = 0) -> DataFrame:
    """`id, rank` of the elected vertices: each round the highest score wins, ties to the smaller id, and its voters weaken."""
    e = materialize(both(edges).select("src", "dst"))
    v = materialize(ends(e))
    n = v.count()
    pairs = e.count()
    weaken = n / pairs if pairs else 0.0
    state = materialize(v.select("id", F.lit(1.0).alias("power"), F.lit(False).alias("done")))
    chosen: list[tuple[object, int]] = []
    for k in range(num_of_nodes or n):
        score = e.join(state.select(F.col("id").alias("dst"), "power"), "dst").groupBy(F.col("src").alias("id")).agg(F.round(F.sum("power"), 8).alias("score"))
        top = state.where("not done").join(score, "id").orderBy(F.desc("score"), "id").first()
        if top is None or top.score < 1e-8:
            break
        chosen.append((top.id, k + 1))
        near = e.where(F.col("src") == F.lit(top.id)).select(F.col("dst").alias("id"), F.lit(weaken).alias("less"))
        power = F.when(F.col("id") == F.lit(top.id), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("power") - F.coalesce("less", F.lit(0.0))))
        state = materialize(state.join(near, "id", "left").select("id", power.alias("power"), (F.col("done") | (F.col("id") == F.lit(top.id))).alias("done")))
    return v.sparkSession.createDataFrame(chosen, f"id {dict(v.dtypes)['id']}, rank int")


def eigenvector_flash(edges: DataFrame, max_round: int = 10) -> DataFrame:
    """`id, centrality`: fixed rounds over edges in both directions, each divided by the root of the sum."""
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e, v = _frames(e.withColumn("w", F.lit(1.0)), None)
    n = max(v.count(), 1)
    state, root = materialize(v.select("id", F.lit(1.0 / n).alias("x")), "id"), 1.0
    for _ in range(max_round):
        got = e.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") / F.lit(root)).alias("m"))
        state, seen = measured(v.join(got, "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("x")), {"s": F.sum("x")}, "id", state)
        root = (seen["s"] or 1.0) ** 0.5
    return state.select("id", (F.col("x") / root).alias("centrality"))


def katz_flash(edges: DataFrame, alpha: float = 0.1, max_round: int = 10) -> DataFrame:
    """`id, centrality`: fixed rounds from 1, alpha times the sum of 1 + x over outgoing edges."""
    e, v = _frames(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w")), None)
    state = materialize(v.select("id", F.lit(1.0).alias("x")), "id")
    for _ in range(max_round):
        got = e.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") + 1).alias("m"))
        state = materialize(v.join(got, "id", "left").select("id", (F.coalesce("m", F.lit(0.0)) * alpha).alias("x")), "id", state)
    return state.select("id", F.col("x").alias("centrality"))


# -- traversal ---------------------------------------------------------------------------------------------------
def sssp(edges: DataFrame, source: object, vertices: DataFrame | None = None, weighted: bool = True, undirected: bool = False) -> DataFrame:
    """`id, distance`, null where the source doesn't reach; weights must not be negative."""
    e, v = _frames(both(edges) if undirected else edges, vertices)
    d = _multi_source(e, v.where(F.col("id") == F.lit(source)), weighted)
    return v.join(d.select("id", F.col("dist").alias("distance")), "id", "left")


def sssp_path(edges: DataFrame, source: object, weighted: bool = True) -> DataFrame:
    """`src, dst, distance`: the edges of a tree of shortest paths, the predecessor of least id on ties."""
    e = bucketed(edges.select("src", "dst", (F.col("w").cast("double") if weighted else F.lit(1.0)).alias("w")), "src")
    d = materialize(_multi_source(e, ends(e).where(F.col("id") == F.lit(source)), weighted).select("id", "dist"))
    hops = e.join(d.select(F.col("id").alias("src"), F.col("dist").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("dist").alias("dd")), "dst")
    on = (F.col("ds") + F.col("w") == F.col("dd")) & (F.col("ds") < F.col("dd")) & (F.col("dst") != F.lit(source))
    return hops.where(on).groupBy("dst").agg(F.min("src").alias("src"), F.first("dd").alias("distance")).select("src", "dst", "distance")


def random_multi_bfs(edges: DataFrame, k: int = 64, seed: int = 0, sources: DataFrame | None = None) -> DataFrame:
    """`id, res`: the greatest distance from any of k sources (the first by a hash of the seed) that reaches it; -1 if none does."""
    v = ends(edges)
    picked = v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k) if sources is None else sources
    d = _multi_source(edges, picked.select("id"), False).groupBy("id").agg(F.max("dist").cast("int").alias("res"))
    return v.join(d, "id", "left").fillna(-1, ["res"])


def bfs(edges: DataFrame, source: object, vertices: DataFrame | None = None, undirected: bool = False, depth_limit: int | None = None) -> DataFrame:
    """`id, depth, predecessor` of reached vertices; the source precedes itself, ties go to the smaller predecessor."""
    e, v = _frames(both(edges) if undirected else edges, vertices)
    level = materialize(v.where(F.col("id") == F.lit(source)).select("id", F.lit(0).alias("depth"), F.col("id").alias("predecessor")))
    known, k = Grown(level), 0
    while depth_limit is None or k < depth_limit:
        k += 1
        step = level.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("predecessor"))
        new = step.join(known.rows().select("id"), "id", "left_anti").select("id", F.lit(k).alias("depth"), "predecessor")
        level, seen = measured(new, {"n": F.count(F.lit(1))})
        if not seen["n"]:
            break
        known.add(level)
    release(e, v)
    return known.rows()


def all_pairs_shortest_path_length(edges: DataFrame, vertices: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """`source, id, dist` of all reachable pairs."""
    return _all_sources(edges, vertices, weighted)


def average_shortest_path_length(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """One row `value`: the sum of distances over n (n - 1)."""
    d = _amounts(edges, weighted=weighted)
    # every vertex is its own at 0, once
    n = F.count_if(F.col("dist") == 0) if not weighted else F.count_distinct("source")
    return d.agg(F.sum(F.col("dist") * F.col("n")).alias("s"), n.alias("v")).select((F.col("s") / F.greatest(F.col("v") * (F.col("v") - 1), F.lit(1)).cast("double")).alias("value"))


def has_path(edges: DataFrame, source: object, target: object) -> bool:
    return not bfs(edges, source).where(F.col("id") == F.lit(target)).isEmpty()


def is_simple_path(edges: DataFrame, nodes: list, vertices: DataFrame | None = None) -> bool:
    """One node: it exists. More: no repeats, and every step is an edge."""
    if not nodes or len(set(nodes)) != len(nodes):
        return False
    v = ends(edges) if vertices is None else vertices
    if len(nodes) == 1:
        return not v.where(F.col("id") == F.lit(nodes[0])).isEmpty()
    steps = edges.sparkSession.createDataFrame(list(zip(nodes, nodes[1:])), f"src {dict(edges.dtypes)['src']}, dst {dict(edges.dtypes)['dst']}")
    return steps.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").isEmpty()


def all_simple_paths(edges: DataFrame, source: object, targets: list, cutoff: int) -> DataFrame:
    """`path` arrays from the source to any target, without repeated vertices, of at most `cutoff` edges."""
    e = edges.select("src", "dst").distinct()
    rows = e.where(F.col("src") == F.lit(source)).where("src <> dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    found, hit = rows.where(F.col("end").isin(targets)), rows.where(~F.col("end").isin(targets) if len(targets) == 1 else F.lit(True))
    for _ in range(cutoff - 1):
        rows = hit.join(e, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        found, hit = found.unionByName(rows.where(F.col("end").isin(targets))), rows.where(~F.col("end").isin(targets) if len(targets) == 1 else F.lit(True))
    return found.select("path")


# -- connectivity ------------------------------------------------------------------------------------------------
def wcc(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id, component` (the least id): least labels along edges in both directions, with pointer jumping."""
    e, v = _frames(both(edges), vertices)
    state = materialize(v.select("id", F.col("id").alias("component")), "id")
    while True:
        got = e.join(state.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("m"))
        near = state.join(got, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("via"), F.col("component").alias("was"))
        jump = state.select(F.col("id").alias("via"), F.col("component").alias("far"))
        new = near.join(jump, "via").select("id", F.col("far").alias("component"), (F.col("far") < F.col("was")).alias("moved"))
        state, seen = measured(new, {"moved": F.count_if(F.col("moved"))}, "id", state)
        if not seen["moved"]:
            release(e, v)
            return state.select("id", "component")


def _spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Least `x` of all vertices that reach a vertex, its own included."""
    state = materialize(state, "id")
    while True:
        got = edges.join(state.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("x").alias("m"))
        new = state.select("id", "x").join(got, "id", "left").select("id", F.least("x", F.coalesce("m", "x")).alias("x"), (F.col("m") < F.col("x")).alias("moved"))
        state, seen = measured(new, {"moved": F.count_if(F.col("moved"))}, "id", state)
        if not seen["moved"]:
            return state.select("id", "x")


def scc(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id, component` (the least id): rounds of forward colouring and backward reach within a colour."""
    e, v = _frames(edges, vertices)
    left, done = v, None
    e = e.select("src", "dst").where("src <> dst").distinct()
    while not left.isEmpty():
        color = _spread(e, left.select("id", F.col("id").alias("x")))
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        inside = back.join(color.select(F.col("id").alias("src"), F.col("x").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("x").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        inside = materialize(inside)
        reach = materialize(color.where("id = x"))
        front = reach
        while True:
            step = front.select(F.col("id").alias("src"), "x").join(inside, "src").select(F.col("dst").alias("id"), "x").distinct()
            front = materialize(step.join(reach.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            reach = materialize(reach.unionByName(front))
        found = reach.select("id", F.col("x").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = materialize(left.join(found.select("id"), "id", "left_anti"))
        e = materialize(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return v.select("id", F.col("id").alias("component")) if done is None else done


# -- communities and cores ---------------------------------------------------------------------------------------
def label_propagation(edges: DataFrame, vertices: DataFrame | None = None, max_round: int = 10) -> DataFrame:
    """`id, label`: the commonest label of the neighbours each round, ties to the smaller label."""
    e, v = _frames(both(edges), vertices)
    state = materialize(v.select("id", F.col("id").alias("label")), "id")
    for _ in range(max_round):
        votes = e.join(state.select(F.col("id").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        won = votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("won"))
        new = state.join(won, "id", "left").select("id", F.coalesce("won", "label").alias("label"), (F.col("won") != F.col("label")).alias("moved"))
        state, seen = measured(new, {"moved": F.count_if(F.col("moved"))}, "id", state)
        if not seen["moved"]:
            break
    return state.select("id", "label")


def fluid_communities(edges: DataFrame, k: int = 10, max_round: int = 100, seed: int = 0) -> DataFrame:
    """`id, label` (0 to k - 1, -1 where no community came): k seeds, the first by a hash, spread with density 1 / size.

    Each round a vertex takes the community of greatest total density among itself and its neighbours, its own on ties,
    else the smaller label. Ends when nothing moves or every vertex that moves only returns to its label of two rounds before.
    """
    e, v = _frames(both(edges), None)
    w = Window.orderBy("h", "id")
    first = v.select("id", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h", "id").limit(k).select("id", (F.row_number().over(w) - 1).alias("label"))
    state = materialize(v.join(first, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.lit(-2).alias("l1")), "id")
    for _ in range(max_round):
        size = state.where("label >= 0").groupBy("label").agg((F.lit(1.0) / F.count(F.lit(1))).alias("density"))
        near = e.join(state.select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("id"), "label").unionByName(state.select("id", "label")).where("label >= 0")
        votes = near.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n")).join(size, "label").select("id", "label", F.round(F.col("n") * F.col("density"), 10).alias("d"))
        own = state.select("id", F.col("label").alias("own"), F.col("l1").alias("l2"))
        best = votes.join(own, "id").groupBy("id").agg(F.min_by("label", F.struct(-F.col("d"), F.col("label") != F.col("own"), "label")).alias("to"))
        new = own.join(best, "id", "left").select("id", F.coalesce("to", "own").alias("label"), F.col("own").alias("l1"), ((F.coalesce("to", "own") != F.col("own")) & (F.coalesce("to", "own") != F.col("l2"))).alias("moved"))
        state, seen = measured(new, {"moved": F.count_if(F.col("moved"))}, "id", state)
        if not seen["moved"]:
            break
    return state.select("id", "label")


def _peeled(e: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The `state` (`id, d, gone`; d: neighbours that aren't gone) after vertices with fewer than k are peeled off again and
    again. Only what goes in a round tells its neighbours; edges are read and not written again."""
    due = ~F.col("gone") & (F.col("d") < k)
    state, seen = measured(state.select("id", "d", (F.col("gone") | due).alias("gone"), due.alias("due")), {"due": F.count_if(F.col("due"))}, "id", state)
    while seen["due"]:
        less = e.join(state.where("due").select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("less"))
        left = state.join(less, "id", "left").select("id", (F.col("d") - F.coalesce("less", F.lit(0))).alias("d"), "gone")
        state, seen = measured(left.select("id", "d", (F.col("gone") | due).alias("gone"), due.alias("due")), {"due": F.count_if(F.col("due"))}, "id", state)
    return state


def _degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undirected edges in buckets, and `id, d, gone` of their ends."""
    e = bucketed(both(edges).select("src", "dst"), "src")
    return e, bucketed(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")).withColumn("gone", F.lit(False)), "id")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """`id` of the vertices left when those of degree below k are peeled off again and again."""
    e, state = _degrees(edges)
    return _peeled(e, state, k).where("not gone").select("id")


def core_numbers(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id, core`: each vertex's value falls to the largest h such that h neighbours have at least h, to the fixpoint."""
    e, v = _frames(both(edges), vertices)
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("core"))
    state = materialize(v.join(degree, "id", "left").fillna(0, ["core"]), "id")
    w = Window.partitionBy("id").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        # how many neighbours have each value: a hub's neighbours become one row per value before they meet
        have = e.join(state.select(F.col("id").alias("src"), "core"), "src").groupBy(F.col("dst").alias("id"), "core").agg(F.count(F.lit(1)).alias("n"))
        h = have.select("id", F.least(F.sum("n").over(w), "core").cast("int").alias("h")).groupBy("id").agg(F.max("h").alias("h"))
        new = state.select("id", "core").join(h, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("core"), (F.coalesce("h", F.lit(0)) < F.col("core")).alias("moved"))
        state, seen = measured(new, {"moved": F.count_if(F.col("moved"))}, "id", state)
        if not seen["moved"]:
            return state.select("id", "core")


def k_shell(edges: DataFrame, k: int | None = None) -> DataFrame:
    """`id` of the vertices with core number k: what is peeled off the k-core for the next one. None: the least core
    number there is, which is the least degree, as no vertex has fewer neighbours in the whole graph."""
    e, state = _degrees(edges)
    if k is None:
        k = state.agg(F.min("d")).first()[0] or 0
    else:
        state = _peeled(e, state, k)
    state = materialize(state.where("not gone").select("id", "d", "gone"), "id", state)
    return _peeled(e, state, k + 1).where("gone").select("id")


def louvain(edges: DataFrame, vertices: DataFrame | None = None, min_progress: float = 1e-4, max_level: int = 10, max_round: int = 10, progress_tries: int = 1) -> DataFrame:
    """`id, community`: rounds of local moves (to the neighbouring community of most gain, ties to the smaller id; only
    to a smaller id in odd and a larger one in even rounds, so that neighbours don't swap), then contraction, while
    modularity grows by `min_progress`; `progress_tries` levels may fall short of that before it ends."""
    e0, v = _frames(both(edges), vertices)
    members = materialize(v.select("id", F.col("id").alias("community")))
    e = e0
    last = -1.0
    for _ in range(max_level):
        total = e.agg(F.sum("w")).first()[0] or 0.0
        if total == 0.0:
            break
        degree = materialize(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        state = materialize(degree.select("id", "k", F.col("id").alias("c")))
        for turn in range(max_round):
            weight = state.groupBy("c").agg(F.sum("k").alias("kc"))
            links = e.where("src <> dst").join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("kin"))
            options = links.join(state.select("id", "k", F.col("c").alias("own")), "id").join(weight, "c")
            rest = F.col("kc") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            options = options.withColumn("gain", F.round(F.col("kin") - F.col("k") * rest / total, 9))
            stay = options.where("c = own").select("id", F.col("gain").alias("stay"))
            side = F.col("c") < F.col("own") if turn % 2 == 0 else F.col("c") > F.col("own")
            best = options.where(side).groupBy("id").agg(F.min_by("c", F.struct(-F.col("gain"), "c")).alias("to"), F.max("gain").alias("gain"))
            alone = state.join(weight, "c").select("id", (-F.col("k") * (F.col("kc") - F.col("k")) / total).alias("alone"))
            moved = state.join(best, "id", "left").join(stay, "id", "left").join(alone, "id", "left")
            go = F.col("gain") > F.coalesce("stay", F.round("alone", 9))
            new = materialize(moved.select("id", "k", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), F.coalesce(go, F.lit(False)).alias("go")))
            state = new.select("id", "k", "c")
            if new.where("go").isEmpty():
                break
        e = materialize(
            e.join(state.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src")
            .join(state.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
            .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst"))
            .agg(F.sum("w").alias("w"))
        )
        inner = e.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
        squares = e.groupBy("src").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
        q = inner / total - squares / (total * total)
        if q - last < min_progress:
            progress_tries -= 1
            if progress_tries <= 0:
                break
        last = max(q, last)
        members = materialize(members.join(state.select(F.col("id").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
    return members


# -- clustering and counting -------------------------------------------------------------------------------------
def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, from the smaller (degree, id) to the larger: hubs have few out-edges."""
    e = both(edges).select("src", "dst")
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return materialize(e.where("d < d2 or (d = d2 and src < dst)").select("src", "dst"))


def triangle_list(edges: DataFrame) -> DataFrame:
    """`a, b, c`, each triangle once."""
    o = oriented(edges)
    x, y = o.select(F.col("src").alias("a"), F.col("dst").alias("b")), o.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    wedge = x.join(y, "a").where("b <> c")
    return wedge.join(o.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangles(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id, triangles` that a vertex is part of."""
    v = ends(edges) if vertices is None else vertices.select("id").distinct()
    t = triangle_list(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return v.join(t, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def _directed_degrees(edges: DataFrame) -> DataFrame:
    """`id, dt, dr`: distinct edges in and out, and how many neighbours are both."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    sides = e.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("o")))
    pairs = sides.groupBy("id", "o").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("id").agg(F.sum("n").alias("dt"), F.count_if(F.col("n") == 2).alias("dr"))


def triangle_codes(edges: DataFrame) -> DataFrame:
    """`a, b, c, ab, bc, ac`: each triangle once, with the directions of its edges (1 as written, 2 the other way, 3 both)."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    code = e.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1).alias("k")).unionByName(e.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(2).alias("k"))).groupBy("x", "y").agg(F.sum("k").alias("k"))
    o = oriented(edges).join(code.select(F.col("x").alias("src"), F.col("y").alias("dst"), "k"), ["src", "dst"])
    o = materialize(o)
    x, y = o.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("k").alias("ab")), o.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("k").alias("ac"))
    close = o.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("k").alias("bc"))
    return x.join(y, "a").where("b <> c").join(close, ["b", "c"])


def clustering(edges: DataFrame, vertices: DataFrame | None = None, degree_threshold: int = 1_000_000_000, directed: bool = False) -> DataFrame:
    """`id, coefficient`: triangles over pairs of neighbours; 0 below two neighbours or above the threshold.

    Directed: all ways to go round the triangles of a vertex over those that its edges would allow.
    """
    if directed:
        v = ends(edges) if vertices is None else vertices.select("id").distinct()
        ways = F.lit(1)
        for c in ("ab", "bc", "ac"):
            ways = ways * F.when(F.col(c) == 3, 2).otherwise(1)
        t = triangle_codes(edges).select(F.explode(F.array("a", "b", "c")).alias("id"), ways.alias("k")).groupBy("id").agg(F.sum("k").alias("t"))
        most = F.col("dt") * (F.col("dt") - 1) - 2 * F.col("dr")
        rows = v.join(_directed_degrees(edges), "id", "left").join(t, "id", "left")
        return rows.select("id", F.when((most > 0) & (F.col("dt") <= degree_threshold), F.coalesce("t", F.lit(0)) / most).otherwise(0.0).alias("coefficient"))
    degree = both(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    ok = (F.col("d") > 1) & (F.col("d") <= degree_threshold)
    return triangles(edges, vertices).join(degree, "id", "left").select("id", F.when(ok, F.col("triangles") / pairs).otherwise(0.0).alias("coefficient"))


def avg_clustering(edges: DataFrame, directed: bool = False) -> DataFrame:
    return clustering(edges, directed=directed).agg(F.avg("coefficient").alias("value"))


def transitivity(edges: DataFrame) -> DataFrame:
    """One row `value`: closed over all ordered pairs of neighbours."""
    d = both(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.sum(F.col("d") * (F.col("d") - 1)).alias("p"))
    t = triangle_list(edges).agg(F.count(F.lit(1)).alias("t"))
    return t.select((6 * F.col("t") / d.scalar()).alias("value"))


def k_clique_count(edges: DataFrame, k: int) -> DataFrame:
    """One row `n`: cliques of k vertices, grown along oriented edges and closed by semi-joins."""
    o = oriented(edges)
    rows = o.select(F.col("src").alias("c0"), F.col("dst").alias("c1"))
    for j in range(2, k):
        rows = rows.join(o.select(F.col("src").alias("c0"), F.col("dst").alias(f"c{j}")), "c0")
        for i in range(1, j):
            rows = rows.join(o.select(F.col("src").alias(f"c{i}"), F.col("dst").alias(f"c{j}")), [f"c{i}", f"c{j}"], "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n"))


def three_path_count(edges: DataFrame) -> DataFrame:
    """One row `n`: paths of three edges over four different vertices, each once."""
    e = both(edges).select("src", "dst")
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    mid = e.where("src < dst").join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    t = triangle_list(edges).agg((3 * F.count(F.lit(1))).alias("t"))
    return mid.agg((F.coalesce(F.sum((F.col("d") - 1) * (F.col("d2") - 1)), F.lit(0)) - t.scalar()).alias("n"))


def tailed_triangle_count(edges: DataFrame) -> DataFrame:
    """One row `n`: triangles with one more edge at a corner."""
    degree = both(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    return triangles(edges).join(degree, "id").agg(F.coalesce(F.sum(F.col("triangles") * (F.col("d") - 2)), F.lit(0)).alias("n"))


def rectangle_count(edges: DataFrame) -> DataFrame:
    """One row `n`: cycles of four vertices, each at its vertex of highest (degree, id): paths of two edges from there,
    over vertices that come before it, that end at one vertex make a cycle with each other. No vertex pairs up all its
    neighbours."""
    e = both(edges).select("src", "dst")
    rank = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    key = lambda c: rank.select(F.col("id").alias(c), F.struct("d", "id").alias(f"r_{c}"))
    ranked = materialize(e.join(key("src"), "src").join(key("dst"), "dst"))
    down = ranked.where("r_dst < r_src").select(F.col("src").alias("v"), F.col("r_src").alias("top"), F.col("dst").alias("u"))
    step = ranked.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("r_dst").alias("r"))
    paths = down.join(step, "u").where("r < top").groupBy("v", "w").agg(F.count(F.lit(1)).alias("k"))
    return paths.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("n"))


def diamond_count(edges: DataFrame) -> DataFrame:
    """One row `n`: two triangles over one edge."""
    sides = F.array(*[F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))])
    at = triangle_list(edges).select(F.explode(sides).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("k"))
    return at.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("n"))


def directed_triangle_count(edges: DataFrame, kind: str) -> DataFrame:
    """One row `n`, over triangles listed once by degree order:

    cyclic (x->y->z->x), acyclic (x->y->z, x->z), and those with an edge in both directions x<->y: cycle_plus (y->z->x),
    in_plus (x->z, y->z) and out_plus (z->x, z->y).
    """
    to = {}
    for x, y, c in (("a", "b", "ab"), ("b", "c", "bc"), ("a", "c", "ac")):
        to[x, y], to[y, x] = (F.col(c).bitwiseAND(1) != 0), (F.col(c).bitwiseAND(2) != 0)
    total = F.lit(0)
    for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")):
        two = to[x, y] & to[y, x]
        if kind == "cyclic":
            found = to[x, y] & to[y, z] & to[z, x] if x == "a" else None
        elif kind == "acyclic":
            found = to[x, y] & to[y, z] & to[x, z]
        elif kind == "cycle_plus":
            found = two & to[y, z] & to[z, x]
        else:
            found = (two & (to[x, z] & to[y, z] if kind == "in_plus" else to[z, x] & to[z, y])) if x < y else None
        if found is not None:
            total = total + found.cast("int")
    return triangle_codes(edges).agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("n"))


# -- sets, matchings, forests ------------------------------------------------------------------------------------
def _priority(c: str) -> Column:
    """A fixed random order of vertices, ties impossible."""
    return F.struct(F.xxhash64(c), F.col(c))


def maximal_independent_set(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id` of the set: the vertices first in a fixed random order among their undecided neighbours join, round by round."""
    e, v = _frames(both(edges), vertices)
    e, left, chosen = e.select("src", "dst"), v, v.where(F.lit(False))
    while not left.isEmpty():
        least = e.groupBy(F.col("src").alias("id")).agg(F.min(_priority("dst")).alias("p"))
        new = materialize(left.join(least, "id", "left").where(F.col("p").isNull() | (_priority("id") < F.col("p"))).select("id"))
        out = new.unionByName(e.join(new.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()
        left = materialize(left.join(out, "id", "left_anti"))
        e = materialize(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        chosen = chosen.unionByName(new)
    return chosen


def maximal_matching(edges: DataFrame) -> DataFrame:
    """`src, dst` (src < dst): edges first in a fixed random order at both ends are taken, round by round."""
    e = materialize(both(edges).where("src < dst").select("src", "dst", F.struct(F.xxhash64("src", "dst"), "src", "dst").alias("p")))
    taken = e.select("src", "dst").where(F.lit(False))
    while not e.isEmpty():
        at = e.select(F.explode(F.array("src", "dst")).alias("id"), "p").groupBy("id").agg(F.min("p").alias("m"))
        new = e.join(at.select(F.col("id").alias("src"), F.col("m").alias("m1")), "src").join(at.select(F.col("id").alias("dst"), F.col("m").alias("m2")), "dst")
        new = materialize(new.where("p = m1 and p = m2").select("src", "dst"))
        used = new.select(F.explode(F.array("src", "dst")).alias("id"))
        e = materialize(e.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        taken = taken.unionByName(new)
    return taken


def minimal_vertex_cover(edges: DataFrame) -> DataFrame:
    """`id`: all vertices with an edge but those of a maximal independent set; no vertex of it can be left out."""
    return ends(both(edges)).join(maximal_independent_set(edges), "id", "left_anti")


def minimal_dominating_set(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id`: a maximal independent set dominates all others, and minimally."""
    return maximal_independent_set(edges, vertices)


def minimal_edge_cover(edges: DataFrame) -> DataFrame:
    """`src, dst`: a maximal matching and, for each vertex it leaves out, the edge to its least neighbour."""
    m = materialize(maximal_matching(edges))
    e = both(edges)
    bare = e.join(m.select(F.explode(F.array("src", "dst")).alias("src")), "src", "left_anti").groupBy("src").agg(F.min("dst").alias("dst"))
    return m.unionByName(bare.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct()


def graph_coloring(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """`id, color`: least colour not used by any neighbour of larger (degree, id), to the fixpoint."""
    e, v = _frames(both(edges), vertices)
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    up = materialize(e.where("d2 < d or (d2 = d and dst < src)").select("src", "dst"))  # from larger to smaller
    state = materialize(v.select("id", F.lit(0).alias("color")))
    while True:
        used = up.join(state.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.collect_set("color").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
        new = materialize(state.join(used, "id", "left").select("id", F.when(F.col("used").isNull(), 0).otherwise(free).alias("color"), F.col("color").alias("was")))
        state = new.select("id", "color")
        if new.where("color <> was").isEmpty():
            return state


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """`src, dst, w` (src < dst): every component takes its lightest edge outwards (ties by ends), components merge."""
    e = materialize(both(edges).where("src < dst").select("src", "dst", "w"))
    comp = materialize(ends(e).select("id", F.col("id").alias("c")))
    forest = e.where(F.lit(False))
    while True:
        cut = e.join(comp.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(comp.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        cut = materialize(cut)
        if cut.isEmpty():
            return forest
        sides = cut.select(F.explode(F.array("cs", "cd")).alias("c"), F.struct("w", "src", "dst", "cs", "cd").alias("x"))
        new = materialize(sides.groupBy("c").agg(F.min("x").alias("x")).select("x.*").distinct())
        forest = materialize(forest.unionByName(new.select("src", "dst", "w")))
        merged = wcc(new.select(F.col("cs").alias("src"), F.col("cd").alias("dst"), F.lit(1.0).alias("w")))
        comp = materialize(comp.join(merged.select(F.col("id").alias("c"), "component"), "c", "left").select("id", F.coalesce("component", "c").alias("c")))


# -- assortativity and boundaries --------------------------------------------------------------------------------
def degree_assortativity(edges: DataFrame, x: str = "out", y: str = "in", weighted: bool = False) -> DataFrame:
    """One row `value`: correlation of the source's x-degree with the destination's y-degree over all edges; degrees count
    edges, or add up their weights."""
    side = {"out": "src", "in": "dst"}

    def degree(kind: str) -> DataFrame:
        return edges.groupBy(F.col(side[kind]).alias("id")).agg((F.sum("w") if weighted else F.count(F.lit(1))).alias("d"))

    rows = edges.join(degree(x).select(F.col("id").alias("src"), F.col("d").alias("dx")), "src", "left").join(degree(y).select(F.col("id").alias("dst"), F.col("d").alias("dy")), "dst", "left")
    return rows.fillna(0, ["dx", "dy"]).agg(F.corr("dx", "dy").alias("value"))


def numeric_assortativity(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row `value`: correlation of a numeric attribute (`id, a`) over the two ends of all edges."""
    rows = edges.join(attributes.select(F.col("id").alias("src"), F.col("a").alias("x")), "src").join(attributes.select(F.col("id").alias("dst"), F.col("a").alias("y")), "dst")
    return rows.agg(F.corr("x", "y").alias("value"))


def attribute_assortativity(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row `value` by the mixing matrix of `attributes` (`id, a`): (trace - Σ a b) / (1 - Σ a b)."""
    rows = edges.join(attributes.select(F.col("id").alias("src"), F.col("a").alias("x")), "src").join(attributes.select(F.col("id").alias("dst"), F.col("a").alias("y")), "dst")
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)))
    row_sums, col_sums = cells.groupBy("x").agg(F.sum("n").alias("a")), cells.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("b"))
    ab = row_sums.join(col_sums, "x").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    trace = cells.where("x = y").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    n = F.lit(1.0) * total.scalar()
    s = F.coalesce(ab.scalar(), F.lit(0.0)) / (n * n)
    return trace.select(((F.col("t") / n - s) / (1 - s)).alias("value"))


def average_degree_connectivity(edges: DataFrame, source: str = "in+out", target: str = "in+out", weighted: bool = False) -> DataFrame:
    """`degree, connectivity`: mean target degree of the neighbours of vertices of each source degree, by edge weight if asked."""

    def degree(kind: str) -> DataFrame:
        cols = {"in": ["dst"], "out": ["src"], "in+out": ["src", "dst"]}[kind]
        return edges.select(F.explode(F.array(*cols)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))

    w = (F.col("w") if weighted else F.lit(1)).alias("w")
    out, back = edges.select("src", "dst", w), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w)
    near = {"out": out, "in": back, "in+out": out.unionByName(back)}[source]
    rows = near.join(degree(source).select(F.col("id").alias("src"), F.col("d").alias("degree")), "src").join(degree(target).select(F.col("id").alias("dst"), F.col("d").alias("dt")), "dst")
    return rows.groupBy("degree").agg((F.sum(F.col("dt") * F.col("w")) / F.sum("w")).alias("connectivity"))


def node_boundary(edges: DataFrame, s: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """`id`: out-neighbours of S that aren't in S (and are in T, if given)."""
    near = edges.join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    near = near.join(s.select("id"), "id", "left_anti")
    return near if t is None else near.join(t.select("id"), "id", "left_semi")


def edge_boundary(edges: DataFrame, s: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """`src, dst` from S to T; without T, to what isn't in S. With T, ends in S count too."""
    from_s = edges.select("src", "dst").distinct().join(s.select(F.col("id").alias("src")), "src", "left_semi")
    return from_s.join(s.select(F.col("id").alias("dst")), "dst", "left_anti") if t is None else from_s.join(t.select(F.col("id").alias("dst")), "dst", "left_semi")


@dataclass
class Algorithm:
    """A named algorithm: a plain callable over edges, for CALL and for custom ones."""

    name: str
    run: Callable[..., DataFrame]


REGISTRY: dict[str, Algorithm] = {
    f.__name__: Algorithm(f.__name__, f)
    for f in (
        pagerank, pagerank_fixed, articlerank, personalized_pagerank, hits, degree_centrality, eigenvector_centrality, katz_centrality, closeness_centrality,
        harmonic_centrality, betweenness_centrality, voterank, sssp, bfs, all_pairs_shortest_path_length, average_shortest_path_length, all_simple_paths, wcc, scc,
        label_propagation, k_core, core_numbers, k_shell, louvain, triangles, clustering, avg_clustering, transitivity, k_clique_count, three_path_count,
        tailed_triangle_count, rectangle_count, diamond_count, directed_triangle_count, maximal_independent_set, maximal_matching, minimal_vertex_cover,
        minimal_dominating_set, minimal_edge_cover, graph_coloring, minimum_spanning_forest, degree_assortativity, attribute_assortativity,
        average_degree_connectivity, node_boundary, edge_boundary, numeric_assortativity, sssp_path, random_multi_bfs, eigenvector_flash, katz_flash,
        fluid_communities,
    )
}
