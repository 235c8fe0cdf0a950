"""Mixing sources to target shares of all tokens, by Pareto order sampling.

Every document of a source is to occur `rate` times on average (in proportion to its weight, if weights are given, and
never more than max_repeats times). Its whole copies are certain; the fraction that is left is its inclusion
probability p in an unequal-probability sample. Each document draws random odds u / (1 - u), and documents are taken in
the order of these divided by their inclusion odds p / (1 - p), until the sample has the size in tokens that the
source's share lacks. The order is cut without sorting a source: histograms over ever finer cells of the order find the
cell the cut falls into, and only the rows of that cell are ordered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import DEFAULT_RANKS, count_column

#: The most sources a target table may name; the plan for them is made on the driver.
MOST_SOURCES = 10_000
_SCALE = 52
_STEP = 12


@dataclass
class Share:
    """What one source is to give: its share of the mix, its tokens, copies per unit of weight, and its cap."""

    source: str
    target: float
    available: int
    wanted: float
    rate: float
    most: int


def targets(table: DataFrame) -> list[tuple[str, float, int]]:
    """The target table by source; rows of one source add up, with the larger cap. Null sources and shares of 0 or less are left out."""
    rows = (
        table.where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
        .orderBy("source")
        .limit(MOST_SOURCES + 1)
        .collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [(r.source, float(r.share), max(0, int(r.most))) for r in rows]


def plan(sized: DataFrame, wanted: list[tuple[str, float, int]], total: float | None = None) -> list[Share]:
    """Tokens and rate of each source with documents.

    Shares of sources without tokens can't be given; the others keep their proportions. Without `total` the mix is the
    largest in which no source exceeds its cap, so all have their shares exactly; with it, sources that can't fill
    their part give all they may.
    """
    have = {r.source: (int(r.tokens), float(r.mass)) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("weight")).alias("mass")).collect()}
    present = [(s, share, most) for s, share, most in wanted if have.get(s, (0, 0.0))[1] > 0 and most > 0]
    if not present:
        return []
    whole = sum(share for _, share, _ in present)
    largest = min(most * have[s][0] / (share / whole) for s, share, most in present)
    size = largest if total is None else total
    out = []
    for s, share, most in present:
        tokens = min(size * share / whole, float(most * have[s][0]))
        out.append(Share(s, share / whole, have[s][0], tokens, tokens / have[s][1], most))
    return _fill(sized, out)


def _per_source(shares: list[Share], value: str, column: str = "source") -> Column:
    """A literal per source, as a map lookup: the number of sources is bounded."""
    entries = [x for s in shares for x in (F.lit(s.source), F.lit(getattr(s, value)))]
    return F.element_at(F.create_map(*entries), F.col(column))


def _fill(sized: DataFrame, shares: list[Share]) -> list[Share]:
    """Raises the rates so that the copies of weighted documents, capped, make up the tokens wanted."""
    for _ in range(60):
        e = F.col("weight") * _per_source(shares, "rate")
        capped = e >= _per_source(shares, "most")
        got = sized.groupBy("source").agg(
            F.sum(F.when(capped, F.col("n_tokens") * _per_source(shares, "most")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(~capped, F.col("n_tokens") * F.col("weight")).otherwise(0.0)).alias("free"),
        )
        by = {r.source: (r.fixed, r.free) for r in got.collect()}
        changed = False
        for s in shares:
            fixed, free = by[s.source]
            rate = (s.wanted - fixed) / free if free > 0 else s.rate
            if rate > s.rate * (1 + 1e-12):
                s.rate, changed = rate, True
        if not changed:
            break
    return shares


def uniform(column: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the column's value and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 11).cast("double") + 0.5) / float(1 << 53)


def pareto_key(u: Column, p: Column) -> Column:
    """Place in the Pareto order as a whole number below 2^52: increasing in (u / (1 - u)) / (p / (1 - p))."""
    odds = u * (1 - p)
    return F.floor(odds / (odds + (1 - u) * p) * float((1 << _SCALE) - 1)).cast("long")


def take_to_size(rows: DataFrame, shares: list[Share], needed: dict[str, float]) -> Column:
    """Condition that holds for the rows first in order (`key`, `doc`) whose tokens come nearest to `needed` per source.

    Returns a condition on `source, key, doc`. Only histograms of at most 4096 cells a source reach the driver, and in
    the end the one document at which each source is cut.
    """
    state = {s.source: (0, 1 << _SCALE, 0.0) for s in shares}
    shift = _SCALE
    while shift > 4:
        shift -= _STEP
        inside = F.lit(False)
        for s, (low, high, _) in state.items():
            inside = inside | ((F.col("source") == s) & (F.col("key") >= low) & (F.col("key") < high))
        hist: dict[str, list[tuple[int, float, int]]] = {}
        cells = rows.where(inside).groupBy("source", F.shiftright("key", shift).alias("cell")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        for r in cells.collect():
            hist.setdefault(r.source, []).append((r.cell, float(r.t), r.n))
        crowded = 0
        for s, found in hist.items():
            _, _, before = state[s]
            for cell, t, n in sorted(found):
                state[s] = (cell << shift, (cell + 1) << shift, before)
                if before + t >= needed[s]:
                    crowded = max(crowded, n)
                    break
                before += t
        if crowded <= 1000:
            break
    inside = F.lit(False)
    before = F.lit(0.0)
    for s, (low, high, b) in state.items():
        mine = (F.col("source") == s) & (F.col("key") >= low) & (F.col("key") < high)
        inside, before = inside | mine, F.when(F.col("source") == s, F.lit(b)).otherwise(before)
    w = Window.partitionBy("source").orderBy("key", "doc")
    want = F.element_at(F.create_map(*[x for s in needed for x in (F.lit(s), F.lit(needed[s]))]), F.col("source"))
    upto = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + before
    over = rows.where(inside).withColumn("over", upto + F.col("n_tokens") / 2.0 > want)
    cuts = over.where("over").groupBy("source").agg(F.min(F.struct("key", "doc")).alias("cut")).collect()
    cond = F.lit(False)
    cut = {r.source: r.cut for r in cuts}
    for s, (low, high, _) in state.items():
        own = F.col("source") == s
        if s in cut:
            cond = cond | (own & ((F.col("key") < cut[s].key) | ((F.col("key") == cut[s].key) & (F.col("doc") < cut[s].doc))))
        else:
            cond = cond | (own & (F.col("key") < high))
    return cond


def mix(documents: DataFrame, target: DataFrame, total: float | None = None, weight: str | None = None, seed: int = 7, ranks: str = DEFAULT_RANKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix: `doc_id, source, n_tokens, copies`, a row per document that occurs in it.

    Documents of no or another source, and those without tokens, stay out; a missing or negative weight is 0. Repeated
    rows are documents of their own with the same draw. If no source of the target has tokens, the mix is empty.
    """
    wanted = targets(target)
    mass = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = documents.where(F.col("source").isin([s for s, _, _ in wanted])).select(F.col(doc_id).alias("doc"), "source", F.col(text).alias("text"), mass.alias("weight"))
    sized = materialize(count_column(own, "text", ranks, ("doc", "source", "weight")).where("n_tokens > 0"))
    shares = plan(sized, wanted, total)
    empty = sized.select(F.col("doc").alias(doc_id), "source", "n_tokens", F.lit(0).alias("copies"))
    if not shares:
        return empty.where(F.lit(False))
    expected = F.least(F.col("weight") * _per_source(shares, "rate"), _per_source(shares, "most").cast("double"))
    drawn = (
        sized.where(F.col("source").isin([s.source for s in shares]))
        .withColumn("expected", expected)
        .withColumn("certain", F.floor(F.col("expected") + 1e-9).cast("int"))
        .withColumn("p", F.greatest(F.col("expected") - F.col("certain"), F.lit(0.0)))
        .withColumn("key", F.when(F.col("p") > 1e-9, pareto_key(uniform("doc", seed), F.col("p"))))
    )
    certain = {r.source: float(r.t) for r in drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("certain")).alias("t")).collect()}
    needed = {s.source: max(0.0, s.wanted - certain.get(s.source, 0.0)) for s in shares}
    taken = take_to_size(drawn.where("key is not null"), shares, needed)
    copies = F.col("certain") + F.when(F.col("key").isNotNull() & taken, 1).otherwise(0)
    return drawn.select(F.col("doc").alias(doc_id), "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def actual_shares(mixed: DataFrame, target: DataFrame) -> DataFrame:
    """What each source of the target really got: `source, target_share, n_documents, n_copies, n_tokens, actual_share`; 0 for sources without documents."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("d"), F.sum("copies").alias("c"), F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
    asked = target.where("source is not null").groupBy(F.col("source").alias("s")).agg(F.sum("target_share").alias("target_share"))
    zero = F.lit(0).cast("long")
    rows = asked.join(got, F.col("s") == F.col("source"), "left").select(
        F.col("s").alias("source"), "target_share", F.coalesce("d", zero).alias("n_documents"), F.coalesce("c", zero).alias("n_copies"), F.coalesce("t", zero).alias("n_tokens")
    )
    return rows.withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy()), F.lit(0.0)))
