"""Sampling of neighbourhoods for learning: batches, neighbours per strategy, negatives, subgraphs and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, measured


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) fixed by the seed and the columns, whatever the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def batches(rows: DataFrame, size: int, seed: int = 0, key: str = "id", replacement: bool = False) -> DataFrame:
    """Rows shuffled into batches of about `size`, by hash: the number of batches is fixed, no global order is made.

    replacement: as many draws as there are rows, any row any number of times (a Poisson number of mean 1, up to 12)."""
    n = max(1, -(-rows.count() // size))
    if replacement:
        chance, below, times = 0.36787944117144233, 0.0, F.lit(0)
        for k in range(1, 13):
            below += chance
            times = F.when(uniform(seed, key) >= below, k).otherwise(times)
            chance /= k
        rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), times))).where("draw > 0")
        return rows.withColumn("batch", F.floor(uniform(seed + 1, key, "draw") * n).cast("int")).drop("draw")
    return rows.withColumn("batch", F.floor(uniform(seed, key) * n).cast("int"))


def neighbors(edges: DataFrame, seeds: DataFrame, k: int, strategy: str = "random", seed: int = 0) -> DataFrame:
    """`src, dst` of up to k neighbours of each seed (`id`).

    topk: heaviest first; edge_weight: in proportion to the weight, without replacement; in_degree: in proportion to
    the neighbour's in-degree; random: with replacement, exactly k; full: all. Ties go to the smaller id. Candidates of
    a vertex are cut to k per salt before they meet, so a hub's edges are never ranked in one task.
    """
    e = edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "w")
    if strategy == "full":
        return e.select("src", "dst")
    u = uniform(seed, "src", "dst")
    if strategy == "random":
        # a source's edges lie in cells; a draw first finds its cell by the counts, then its place within the cell
        cell = F.pmod(F.xxhash64("dst"), F.lit(32)).alias("cell")
        placed = e.select("src", "dst", cell).withColumn("r", F.row_number().over(Window.partitionBy("src", "cell").orderBy("dst")))
        sizes = e.select("src", cell).groupBy("src", "cell").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("src").orderBy("cell")))  # at most 32 rows a source
        total = sizes.groupBy("src").agg(F.max("upto").alias("total"))
        draws = total.select("src", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"), "total").withColumn("x", F.floor(uniform(seed, "src", "draw") * F.col("total")).cast("long") + 1)
        found = draws.join(sizes, "src").where((F.col("x") <= F.col("upto")) & (F.col("x") > F.col("upto") - F.col("n")))
        return found.select("src", "cell", (F.col("x") - F.col("upto") + F.col("n")).alias("r")).join(placed, ["src", "cell", "r"]).select("src", "dst")
    if strategy == "topk":
        key = F.struct(-F.col("w"), "dst")
    elif strategy == "edge_weight":
        key = F.struct(-F.log(u) / F.greatest("w", F.lit(1e-300)), "dst")
    elif strategy == "in_degree":
        e = e.join(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("deg")), "dst")
        key = F.struct(-F.log(u) / F.col("deg"), "dst")
    else:
        raise ValueError(f"unknown strategy {strategy}")
    first = Window.partitionBy("src", F.pmod(F.xxhash64("dst"), F.lit(32))).orderBy("key")
    cut = e.withColumn("key", key).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return cut.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("key"))).where(F.col("r") <= k).select("src", "dst")


def hops(edges: DataFrame, seeds: DataFrame, expand_factor: list[int], strategy: str = "random", seed: int = 0) -> DataFrame:
    """`hop, src, dst`: neighbours of neighbours, with a factor per hop."""
    out, at = None, seeds.select("id")
    for h, k in enumerate(expand_factor):
        got = neighbors(edges, at, k, strategy, seed + h)
        layer = got.select(F.lit(h + 1).alias("hop"), "src", "dst")
        out = layer if out is None else out.unionByName(layer)
        at = got.select(F.col("dst").alias("id")).distinct()
    return out


def negatives(edges: DataFrame, candidates: DataFrame, per_source: int, seed: int = 0) -> DataFrame:
    """`src, dst`: for each source exactly `per_source` different candidates that are not its neighbours nor itself, or all
    of them if there are fewer.

    Candidates get dense numbers (a count per range of a hash order, and a place within). Draws that hit a neighbour or
    one drawn before are drawn again, round by round, by the sources that lack some. A source that could not get its
    count in 16 rounds has few candidates left to hit, and gets the first ones of those by hash.
    """
    from ..plans.rows import numbered

    every = candidates.select("id").where("id is not null").distinct()
    known = materialize(edges.select("src", "dst").distinct())
    placed = materialize(numbered(every, [F.xxhash64(F.lit(seed), "id"), F.col("id")], "r"))
    n = placed.count()
    sources = known.select("src").distinct()
    got = materialize(known.where(F.lit(False)))
    if not n:
        return got
    missing = materialize(sources.select("src", F.lit(per_source).cast("long").alias("lack")))
    for turn in range(16):
        # twice as many as are missing, as some will be rejected
        draws = missing.select("src", "lack", F.explode(F.sequence(F.lit(1), 2 * F.col("lack"))).alias("draw"))
        draws = draws.withColumn("r", F.floor(uniform(seed + turn, "src", "draw") * n).cast("long") + 1)
        pairs = draws.join(placed, "r").where("src <> id").groupBy("src", F.col("id").alias("dst"), "lack").agg(F.min("draw").alias("draw"))
        fresh = pairs.join(known, ["src", "dst"], "left_anti").join(got, ["src", "dst"], "left_anti")
        taken = fresh.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("draw"))).where("k <= lack").select("src", "dst")
        got = materialize(got.unionByName(taken), replaces=got)
        have = got.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        missing, seen = measured(sources.join(have, "src", "left").select("src", (F.lit(per_source) - F.coalesce("n", F.lit(0))).alias("lack")).where("lack > 0"), {"n": F.count(F.lit(1))}, replaces=missing)
        if not seen["n"]:
            return got
    # nearly all draws of these sources hit a neighbour, so they have about as many edges as there are candidates: they go
    # through all numbers, which is no more than their edges again
    blocks = missing.select("src", "lack", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4096))).alias("block"))
    numbers = blocks.select("src", "lack", F.explode(F.sequence(F.col("block") * 4096 + 1, F.least(F.lit(n), F.col("block") * 4096 + 4096))).alias("r"))
    rest = numbers.join(placed, "r").where("src <> id").select("src", F.col("id").alias("dst"), "lack", "r")
    rest = rest.join(known, ["src", "dst"], "left_anti").join(got, ["src", "dst"], "left_anti")
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("r"))).where("k <= lack").select("src", "dst")
    return got.unionByName(rest)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in `nodes`."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def split(rows: DataFrame, shares: list[float], seed: int = 0, key: str = "id") -> list[DataFrame]:
    """Disjoint parts with about these shares, the same whenever it runs."""
    u, low, out = uniform(seed, key), 0.0, []
    for s in shares:
        out.append(rows.where((u >= low) & (u < low + s)))
        low += s
    return out
