"""Further algorithms over `src, dst, w`: biconnectivity, orderings, centres, densest parts, colours and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import algorithms as al


def _rooted(u: DataFrame) -> DataFrame:
    """`id, parent, depth` of a breadth-first forest; roots are the least ids of their components and their own parents."""
    two = materialize(u.unionByName(u.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    comp = al.wcc(u.withColumn("w", F.lit(1.0)))
    level = materialize(comp.where("id = component").select("id", F.col("id").alias("parent"), F.lit(0).alias("depth")))
    seen, k = level, 0
    while True:
        k += 1
        step = level.select(F.col("id").alias("src")).join(two, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        level = materialize(step.join(seen.select("id"), "id", "left_anti").select("id", "parent", F.lit(k).alias("depth")))
        if level.isEmpty():
            return seen
        seen = materialize(seen.unionByName(level))


def bcc(edges: DataFrame) -> DataFrame:
    """`src, dst, component` (src < dst): biconnected components of the edges, named by their least edge's number.

    Every edge that isn't in the spanning forest closes a cycle with tree edges: those on its tree path form one
    component. The two ends climb the tree in lock step, and the tree edges met are joined to the closing edge.
    """
    u = materialize(al.both(edges).where("src < dst").select("src", "dst"))
    root = materialize(_rooted(u))
    tree = root.where("id <> parent").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    key = lambda a, b: F.xxhash64(F.least(a, b), F.greatest(a, b))
    extra = u.join(tree, ["src", "dst"], "left_anti").select(key("src", "dst").alias("e"), F.col("src").alias("a"), F.col("dst").alias("b"))
    up_a = root.select(F.col("id").alias("a"), F.col("parent").alias("pa"), F.col("depth").alias("da"))
    up_b = root.select(F.col("id").alias("b"), F.col("parent").alias("pb"), F.col("depth").alias("db"))
    at = materialize(extra)
    links = None
    while not at.isEmpty():
        x = at.join(up_a, "a").join(up_b, "b")
        move_a, move_b = F.col("da") >= F.col("db"), F.col("db") > F.col("da")
        met = x.select("e", F.when(move_a, key("a", "pa")).otherwise(key("b", "pb")).alias("t"))
        links = materialize(met.select(F.col("e").alias("src"), F.col("t").alias("dst")).distinct() if links is None else links.unionByName(met.select(F.col("e").alias("src"), F.col("t").alias("dst"))).distinct())
        at = materialize(x.select("e", F.when(move_a, F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(move_b, F.col("pb")).otherwise(F.col("b")).alias("b")).where("a <> b"))
    all_edges = u.select("src", "dst", key("src", "dst").alias("id"))
    if links is None:
        return all_edges.select("src", "dst", F.col("id").alias("component"))
    comp = al.wcc(links.withColumn("w", F.lit(1.0)))
    return all_edges.join(comp, "id", "left").select("src", "dst", F.coalesce("component", "id").alias("component"))


def bridges(edges: DataFrame) -> DataFrame:
    """`src, dst` (src < dst) of the edges that are components of their own."""
    b = materialize(bcc(edges))
    single = b.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return b.join(single, "component", "left_semi").select("src", "dst")


def cut_points(edges: DataFrame) -> DataFrame:
    """`id` of the vertices that belong to more than one biconnected component."""
    ends = bcc(edges).select(F.explode(F.array("src", "dst")).alias("id"), "component").distinct()
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def onion_layers(edges: DataFrame) -> DataFrame:
    """`id, core, layer`: every round peels all vertices whose degree is no more than the core reached so far."""
    e = materialize(al.both(edges).select("src", "dst"))
    left, out, core, layer = materialize(al.ends(e)), None, 0, 0
    while not left.isEmpty():
        d = materialize(left.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").fillna(0, ["d"]))
        core, layer = max(core, d.agg(F.min("d")).first()[0]), layer + 1
        gone = d.where(F.col("d") <= core).select("id", F.lit(core).alias("core"), F.lit(layer).alias("layer"))
        out = gone if out is None else out.unionByName(gone)
        left = materialize(d.where(F.col("d") > core).select("id"))
        e = materialize(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return al.ends(edges).select("id", F.lit(0).alias("core"), F.lit(0).alias("layer")) if out is None else out


def degeneracy_ordering(edges: DataFrame) -> DataFrame:
    """`id, position`: by core number, layer and id."""
    from ..plans.rows import numbered

    return numbered(onion_layers(edges), [F.col("core"), F.col("layer"), F.col("id")], "position").select("id", "position")


def densest_subgraph(edges: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """`id` of a subgraph of at least half the greatest density / (1 + epsilon): peels below-average vertices, keeps the best."""
    e = materialize(al.both(edges).select("src", "dst"))
    best, best_density = al.ends(e), -1.0
    while True:
        d = materialize(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")))
        s = d.agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("m")).first()
        if not s.n:
            return best
        density = s.m / 2 / s.n
        if density > best_density:
            best, best_density = d.select("id"), density
        keep = materialize(d.where(F.col("d") > 2 * (1 + epsilon) * density).select("id"))
        e = materialize(e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def k_center(edges: DataFrame, k: int = 5) -> DataFrame:
    """`id, ordinal`: first the vertex of most edges (ties to the smaller id), then again and again the farthest from all."""
    e = materialize(al.both(edges))
    v = materialize(al.ends(e))
    top = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "id").first()
    if top is None:
        return v.select("id", F.lit(0).alias("ordinal"))
    chosen = [top.id]
    near = materialize(al.bfs(e, top.id).select("id", F.col("depth").alias("d")))
    while len(chosen) < k:
        far = v.join(near, "id", "left").orderBy(F.coalesce("d", F.lit(1 << 30)).desc(), "id").first()
        if far is None or far.d == 0:
            break
        chosen.append(far.id)
        more = al.bfs(e, far.id).select("id", F.col("depth").alias("m"))
        near = materialize(near.join(more, "id", "full").select("id", F.least("d", "m").alias("d")))
    return v.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(chosen)], f"id {dict(v.dtypes)['id']}, ordinal int")


def diameter_lower_bound(edges: DataFrame, sweeps: int = 2) -> int:
    """Greatest depth of repeated breadth-first searches, each from the last one's farthest vertex."""
    e = materialize(al.both(edges))
    at = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "id").first()
    best = 0
    for _ in range(sweeps + 1):
        if at is None:
            return best
        at = al.bfs(e, at.id).orderBy(F.desc("depth"), "id").first()
        best = max(best, at.depth)
    return best


def lpa_u2i(edges: DataFrame, labels: DataFrame, max_round: int = 10) -> DataFrame:
    """`id, v` (array): label vectors of users go to items and back, as weighted means; `edges` go from users to items."""
    e = materialize(al.both(edges, loops=True))
    state = materialize(labels.select("id", "v"))
    k = state.select(F.max(F.size("v"))).first()[0] or 0
    for _ in range(max_round):
        sent = e.join(state.withColumnRenamed("id", "src"), "src")
        new = sent.groupBy(F.col("dst").alias("id")).agg(F.array(*[F.sum(F.get("v", F.lit(i)) * F.col("w")) / F.sum("w") for i in range(k)]).alias("n"))
        state = materialize(state.join(new, "id", "full").select("id", F.coalesce("n", "v").alias("v")))
    return state


def sampling_path(graph, pattern: str, limit: int, seed: int = 0) -> DataFrame:
    """Paths that match a label pattern `V0-e0-V1-e1-V2...`, from every vertex of the first label; `limit` of them by a fixed random order."""
    from ..plans.rows import Rows

    parts = pattern.split("-")
    rows = Rows.scan(graph, "p0", [parts[0]])
    for i in range(1, len(parts) - 1, 2):
        rows = rows.expand(f"p{i // 2}", f"p{i // 2 + 1}", [parts[i]], "out", [parts[i + 1]])
    cols = [f"p{i}" for i in range(len(parts) // 2 + 1)]
    return rows.df.select(*cols).orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(limit)


for _f in (bcc, bridges, cut_points, onion_layers, degeneracy_ordering, densest_subgraph, k_center, lpa_u2i):
    al.REGISTRY[_f.__name__] = al.Algorithm(_f.__name__, _f)
