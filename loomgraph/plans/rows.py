"""Rows of a graph query: a DataFrame whose columns are the aliases bound so far, with the graph operators on it.

A vertex alias `a` has the columns `a` (id) and `a__label`, an edge alias `e` has `e` (its identity), `e__label`,
`e__src`, `e__dst`, `e__srcl` and `e__dstl`, a path alias its vertices as structs (label, id) and, where asked for, its
edges in `p__edges`; properties that a query uses are columns `alias__property`. A vertex frame is joined only where a property of it is used. Edges are scanned
with the columns that are used, so unused properties never leave the files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, union
from ..operators import held
from ..session import Grown, materialize, measured, release

OUT, IN, BOTH = "out", "in", "both"


def truth(c: Column) -> Column:
    """Two-valued logic: a null condition is false."""
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Rows:
    graph: Graph
    df: DataFrame
    labels: dict[str, frozenset[str]] = field(default_factory=dict)  # vertex alias -> possible labels
    edges: frozenset[str] = frozenset()
    paths: frozenset[str] = frozenset()
    head: str | None = None
    kinds: dict[str, frozenset[tuple[str, str, str]]] = field(default_factory=dict)  # edge alias -> possible triplets

    def _with(self, df: DataFrame, **changes) -> Rows:
        return replace(self, df=df, **changes)

    # -- scans -------------------------------------------------------------------------------------------------
    @staticmethod
    def scan(graph: Graph, alias: str, labels: Iterable[str] | None = None, props: Iterable[str] = ()) -> Rows:
        """All vertices of some labels (None: all)."""
        names = frozenset(labels or graph.labels())
        parts = []
        for x in sorted(names):
            v = graph.vertices[x]
            parts.append(v.select(F.col("id").alias(alias), F.lit(x).alias(f"{alias}__label"), *[F.col(p).alias(f"{alias}__{p}") for p in props if p in v.columns]))
        df = union(parts)
        for p in props:
            if f"{alias}__{p}" not in df.columns:
                df = df.withColumn(f"{alias}__{p}", F.lit(None))
        return Rows(graph, df, {alias: names}, head=alias)

    def _edge_frame(self, triplets: list[tuple[str, str, str]], direction: str, alias: str | None, props: Iterable[str]) -> DataFrame | None:
        parts = []
        for s, e, d in triplets:
            df = self.graph.edges[s, e, d]
            cols = [F.lit(s).alias("_fl"), F.col("src").alias("_f"), F.lit(d).alias("_tl"), F.col("dst").alias("_t")]
            if alias:
                own = [c for c in df.columns]
                cols += [(F.col("eid") if "eid" in own else F.xxhash64(F.lit(s), F.lit(e), F.lit(d), *own)).alias(alias), F.lit(e).alias(f"{alias}__label"), F.col("src").alias(f"{alias}__src"), F.col("dst").alias(f"{alias}__dst"), F.lit(s).alias(f"{alias}__srcl"), F.lit(d).alias(f"{alias}__dstl")]
                cols += [F.col(p).alias(f"{alias}__{p}") for p in props if p in own]
            fwd = df.select(*cols)
            swap = {"_f": "_t", "_t": "_f", "_fl": "_tl", "_tl": "_fl"}
            if direction in (OUT, BOTH):
                parts.append(fwd)
            if direction in (IN, BOTH):
                back = fwd.select(*[F.col(c).alias(swap.get(c, c)) for c in fwd.columns])
                parts.append(back.where("_f <> _t or _fl <> _tl") if direction == BOTH and s == d else back)
        if not parts:
            return None
        out = union(parts)
        for p in props if alias else ():
            if f"{alias}__{p}" not in out.columns:
                out = out.withColumn(f"{alias}__{p}", F.lit(None))
        return out

    @staticmethod
    def scan_edges(graph: Graph, alias: str, edge_labels: Iterable[str] | None = None, props: Iterable[str] = ()) -> Rows:
        """All edges of some labels."""
        empty = Rows(graph, next(iter(graph.vertices.values())))
        df = empty._edge_frame(graph.triplets(edge_labels), OUT, alias, props)
        return Rows(graph, df.drop("_f", "_t", "_fl", "_tl"), {}, frozenset({alias}), head=alias, kinds={alias: frozenset(graph.triplets(edge_labels))})

    # -- expansion ---------------------------------------------------------------------------------------------
    def _legal(self, frm: str, edge_labels: Iterable[str] | None, direction: str, to_labels: Iterable[str] | None) -> list[tuple[str, str, str]]:
        have = self.labels.get(frm)
        found: list[tuple[str, str, str]] = []
        if direction in (OUT, BOTH):
            found += self.graph.triplets(edge_labels, have, to_labels)
        if direction in (IN, BOTH):
            found += [t for t in self.graph.triplets(edge_labels, to_labels, have) if t not in found]
        return found

    def expand(self, frm: str, to: str, edge_labels: Iterable[str] | None = None, direction: str = OUT, to_labels: Iterable[str] | None = None, edge: str | None = None, edge_props: Iterable[str] = (), props: Iterable[str] = (), optional: bool = False) -> Rows:
        """Follows edges of vertex `frm` to vertex `to`, which may be bound already (then it closes a cycle)."""
        if to in self.labels and to_labels is None:
            to_labels = self.labels[to]
        legal = self._legal(frm, edge_labels, direction, to_labels)
        edges = self._edge_frame(legal, direction, edge, edge_props)
        if edges is None:
            raise ValueError(f"no edge of {sorted(edge_labels or [])} fits {frm}->{to}")
        if to_labels is not None:
            edges = edges.where(F.col("_tl").isin(list(to_labels)))
        reached = frozenset(x for s, _, d in legal for x in ((d,) if direction == OUT else (s,) if direction == IN else (s, d)))
        reached = reached & frozenset(to_labels) if to_labels is not None else reached
        on = F.col(frm) == F.col("_f")
        if len(self.labels.get(frm, ())) != 1 or direction == BOTH:
            on = on & (F.col(f"{frm}__label") == F.col("_fl"))
        closing = to in self.df.columns
        if closing:
            on = on & (F.col(to) == F.col("_t")) & (F.col(f"{to}__label") == F.col("_tl"))
        df = self.df.join(edges, on, "left" if optional else "inner")
        if not closing:
            df = df.withColumn(to, F.col("_t")).withColumn(f"{to}__label", F.col("_tl"))
        out = self._with(df.drop("_f", "_t", "_fl", "_tl"), labels={**self.labels, to: reached}, edges=self.edges | ({edge} if edge else set()), head=to, kinds=self.kinds | ({edge: frozenset(legal)} if edge else {}))
        return out.fetch(to, props, optional) if not closing else out

    def fetch(self, alias: str, props: Iterable[str], optional: bool = False) -> Rows:
        """Joins the properties of a vertex alias that aren't there yet."""
        props = [p for p in props if f"{alias}__{p}" not in self.df.columns]
        if not props:
            return self
        names = self.labels[alias]
        v = Rows.scan(self.graph, "_v", names, props).df
        v = v.select(*[F.col(c).alias("_x" + c) for c in v.columns])
        on = F.col(alias) == F.col("_x_v")
        if len(names) > 1:
            on = on & (F.col(f"{alias}__label") == F.col("_x_v__label"))
        df = self.df.join(v, on, "left" if optional else "inner")
        return self._with(df.select(*self.df.columns, *[F.col(f"_x_v__{p}").alias(f"{alias}__{p}") for p in props]))

    def degree(self, frm: str, name: str, edge_labels: Iterable[str] | None = None, direction: str = OUT) -> Rows:
        """Number of incident edges as a column; 0 where there are none."""
        edges = self._edge_frame(self._legal(frm, edge_labels, direction, None), direction, None, ())
        counts = edges.groupBy(F.col("_f"), F.col("_fl")).agg(F.count(F.lit(1)).alias("_n"))
        on = (F.col(frm) == F.col("_f")) & (F.col(f"{frm}__label") == F.col("_fl"))
        return self._with(self.df.join(counts, on, "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_f", "_fl", "_n"))

    def get_v(self, edge: str, to: str, which: str, other: str | None = None, props: Iterable[str] = ()) -> Rows:
        """The START, END, OTHER (than vertex `other`) or BOTH ends of an edge alias."""
        s = F.struct(F.col(f"{edge}__srcl").alias("l"), F.col(f"{edge}__src").alias("i"))
        d = F.struct(F.col(f"{edge}__dstl").alias("l"), F.col(f"{edge}__dst").alias("i"))
        if which == "both":
            end = F.explode(F.array(s, d))
        elif which == "other":
            same = (F.col(f"{edge}__src") == F.col(other)) & (F.col(f"{edge}__srcl") == F.col(f"{other}__label"))
            end = F.when(same, d).otherwise(s)
        else:
            end = s if which == "start" else d
        mine = [t for t in self.graph.triplets() if t in self.triplets_of(edge)]
        ends = frozenset(x for t in mine for x in ((t[0],) if which == "start" else (t[2],) if which == "end" else (t[0], t[2])))
        df = self.df.withColumn("_e", end).withColumn(to, F.col("_e.i")).withColumn(f"{to}__label", F.col("_e.l")).drop("_e")
        return self._with(df, labels={**self.labels, to: ends}, head=to).fetch(to, props)

    def triplets_of(self, edge: str) -> frozenset[tuple[str, str, str]]:
        """The triplets an edge alias may be of."""
        return self.kinds.get(edge, frozenset(self.graph.triplets()))

    # -- paths -------------------------------------------------------------------------------------------------
    def path_expand(self, frm: str, to: str, lower: int, upper: int, edge_labels: Iterable[str] | None = None, direction: str = OUT, to_labels: Iterable[str] | None = None, option: str = "arbitrary", path: str | None = None, until: Callable[[str], Column] | None = None, props: Iterable[str] = (), edge_where: Callable[[str], Column] | None = None, edge_props: Iterable[str] = (), path_edges: Iterable[str] | None = None, optional: bool = False) -> Rows:
        """Paths of `lower` <= hops < `upper`; only their ends are carried unless the path or its option needs more.

        option: arbitrary, simple (no vertex twice) or trail (no edge twice; parallel edges are different ones). until:
        paths end where it holds of the end. path_edges: the path also gets its edges, as structs (label, src, dst) with
        these properties. optional: rows without a path stay, with a null end.
        """
        if optional:
            base = self._with(self.df.select(frm, f"{frm}__label").distinct(), labels={frm: self.labels[frm]}, edges=frozenset(), paths=frozenset())
            got = base.path_expand(frm, to, lower, upper, edge_labels, direction, to_labels, option, path, until, props, edge_where, edge_props, path_edges)
            df = self.df.join(got.df, [frm, f"{frm}__label"], "left")
            return self._with(df, labels={**self.labels, to: got.labels[to]}, paths=self.paths | got.paths, head=path or to)
        keep = path is not None or option == "simple"
        here = lambda a: F.struct(F.col(f"{a}__label").alias("label"), F.col(a).alias("id"))
        closing = to in self.df.columns
        end, labels = "_end", self.labels[frm]
        graph = self.graph.identified(edge_labels) if option == "trail" else self.graph
        step_props = list(dict.fromkeys([*edge_props, *(path_edges or ())]))
        needs_edge = option == "trail" or edge_where or path_edges is not None
        df = self.df.withColumn(end, F.col(frm)).withColumn(f"{end}__label", F.col(f"{frm}__label")).withColumn("_hops", F.lit(0))
        if keep:
            df = df.withColumn("_path", F.array(here(frm)))
        if option == "trail":
            df = df.withColumn("_trail", F.array().cast("array<bigint>"))
        level = self._with(df, labels={**self.labels, end: labels}, graph=graph)
        found: list[Rows] = []
        for hop in range(upper):
            if hop >= lower:
                done = level if until is None or hop == 0 else level._with(level.df.where(truth(until(end))))
                found.append(done)
            if hop + 1 >= upper:
                break
            src = level if until is None or hop == 0 else level._with(level.df.where(~truth(until(end))))
            if not src._legal(end, edge_labels, direction, None):
                break
            nxt = src.expand(end, "_nxt", edge_labels, direction, edge="_edge" if needs_edge else None, edge_props=step_props)
            d = nxt.df
            if edge_where:
                d = d.where(truth(edge_where("_edge")))
            if option == "simple":
                d = d.where(~F.array_contains("_path", here("_nxt")))
            if option == "trail":
                d = d.where(~F.array_contains("_trail", F.col("_edge"))).withColumn("_trail", F.concat("_trail", F.array("_edge")))
            if keep:
                d = d.withColumn("_path", F.concat("_path", F.array(here("_nxt"))))
            if path_edges is not None:
                one = F.array(F.struct(*[F.col(f"_edge__{c}").alias(c) for c in ("label", "src", "dst", *path_edges)]))
                d = d.withColumn("_edges", F.concat("_edges", one) if hop else one)
            d = d.withColumn(end, F.col("_nxt")).withColumn(f"{end}__label", F.col("_nxt__label")).withColumn("_hops", F.lit(hop + 1))
            d = d.drop("_nxt", "_nxt__label", *[c for c in d.columns if c == "_edge" or c.startswith("_edge__")])
            level = nxt._with(d, labels={**self.labels, end: nxt.labels["_nxt"]}, edges=self.edges)
        reached = frozenset().union(*[r.labels[end] for r in found]) if found else frozenset()
        df = union([r.df for r in found]) if found else df.where(F.lit(False))
        if to_labels is not None:
            reached &= frozenset(to_labels)
            df = df.where(F.col(f"{end}__label").isin(list(to_labels)))
        if closing:
            df = df.where((F.col(to) == F.col(end)) & (F.col(f"{to}__label") == F.col(f"{end}__label")))
        else:
            df = df.withColumn(to, F.col(end)).withColumn(f"{to}__label", F.col(f"{end}__label"))
        if path:
            df = df.withColumn(path, F.col("_path"))
            if path_edges is not None and "_edges" in df.columns:
                df = df.withColumn(f"{path}__edges", F.when(F.col("_hops") == 0, F.slice("_edges", 1, 0)).otherwise(F.col("_edges")))
        df = df.drop(end, f"{end}__label", "_hops", "_path", "_trail", "_edges")
        out = self._with(df, labels={**self.labels, to: reached}, paths=self.paths | ({path} if path else set()), head=path or to)
        return out.fetch(to, props) if not closing else out

    def concat_paths(self, first: str, second: str, name: str) -> Rows:
        """One path of two that meet: rows where the last vertex of the first isn't the first of the second go."""
        df = self.df.where(F.get(first, F.size(first) - 1) == F.get(second, F.lit(0)))
        df = df.withColumn(name, F.concat(first, F.slice(F.col(second), F.lit(2), F.size(second))))
        return self._with(df, paths=self.paths | {name}, head=name)

    def shortest(self, frm: str, to: str, upper: int | None = None, edge_labels: Iterable[str] | None = None, direction: str = OUT, to_labels: Iterable[str] | None = None, path: str = "_p", every: bool = False, props: Iterable[str] = (), limit: int | None = None) -> Rows:
        """Shortest paths of fewer than `upper` hops (None: any length) between each pair: any one (the least by its
        vertices), or all.

        Breadth first from the distinct starts, a level at a time: a level is written before the next one begins, a
        vertex that a start has reached before is not entered again, and it ends with the first empty level. If `to` is
        bound, a start goes on only while one of its targets is missing. `limit`: the first so many paths by length and
        vertices; levels beyond those are not searched.
        """
        end = "_end"
        here = lambda a: F.struct(F.col(f"{a}__label").alias("label"), F.col(a).alias("id"))
        closing = to in self.df.columns
        starts = self.df.select(F.col(frm), F.col(f"{frm}__label")).distinct()
        df = starts.withColumn(end, F.col(frm)).withColumn(f"{end}__label", F.col(f"{frm}__label")).withColumn("_path", F.array(here(frm)))
        key = [frm, f"{frm}__label", end, f"{end}__label"]
        level = Rows(self.graph, materialize(df), {frm: self.labels[frm], end: self.labels[frm]})
        seen = Grown(materialize(level.df.select(*key)))
        found: list[DataFrame] = [level.df.where(F.lit(False))]
        reached: frozenset[str] = frozenset()
        wanted = materialize(self.df.select(F.col(frm), F.col(f"{frm}__label"), F.col(to).alias(end), F.col(f"{to}__label").alias(f"{end}__label")).distinct()) if closing else None
        hop, have = 1, 0
        while (upper is None or hop < upper) and level._legal(end, edge_labels, direction, None):
            nxt = level.expand(end, "_nxt", edge_labels, direction)
            d = nxt.df.withColumn("_path", F.concat("_path", F.array(here("_nxt")))).withColumn(end, F.col("_nxt")).withColumn(f"{end}__label", F.col("_nxt__label")).drop("_nxt", "_nxt__label")
            d = d.join(seen.rows(), key, "left_anti")
            d = d.distinct() if every else d.groupBy(*key).agg(F.min("_path").alias("_path"))
            fits = F.lit(True) if to_labels is None else F.col(f"{end}__label").isin(list(to_labels))
            d, size = measured(d, {"n": F.count(F.lit(1)), "fit": F.count_if(fits)})
            if not size["n"]:
                break
            reached |= nxt.labels["_nxt"]
            found.append(d)
            have += size["fit"]
            if limit is not None and have >= limit:
                break
            seen.add(materialize(d.select(*key).distinct()) if every else d.select(*key))
            if wanted is not None:
                wanted, size = measured(wanted.join(d, key, "left_anti"), {"n": F.count(F.lit(1))}, replaces=wanted)
                if not size["n"]:
                    break
                d = d.join(wanted.select(frm, f"{frm}__label").distinct(), [frm, f"{frm}__label"], "left_semi")
            level = Rows(self.graph, d, {frm: self.labels[frm], end: nxt.labels["_nxt"]})
            hop += 1
        paths = union(found)
        if to_labels is not None:
            reached &= frozenset(to_labels)
            paths = paths.where(F.col(f"{end}__label").isin(list(to_labels)))
        if limit is not None:
            paths = paths.orderBy(F.size("_path"), "_path").limit(limit)
        paths = paths.select(F.col(frm).alias("_sf"), F.col(f"{frm}__label").alias("_sl"), F.col(end).alias("_te"), F.col(f"{end}__label").alias("_tl"), F.col("_path").alias(path))
        on = (F.col(frm) == F.col("_sf")) & (F.col(f"{frm}__label") == F.col("_sl"))
        if closing:
            on = on & (F.col(to) == F.col("_te")) & (F.col(f"{to}__label") == F.col("_tl"))
        df = self.df.join(paths, on)
        if not closing:
            df = df.withColumn(to, F.col("_te")).withColumn(f"{to}__label", F.col("_tl"))
        out = self._with(df.drop("_sf", "_sl", "_te", "_tl"), labels={**self.labels, to: reached}, paths=self.paths | {path}, head=path)
        return out.fetch(to, props) if not closing else out

    def _held(self, frm: str, edge_labels: Iterable[str] | None, direction: str, to_labels: Iterable[str] | None, counted: bool = False) -> tuple[held.Held, object] | None:
        """The edges between vertices of `frm`'s one label as arrays, and the places of `frm` in them, if the rows are
        nothing but different vertices of that label and all edges that begin there end there."""
        labels = self.labels.get(frm, frozenset())
        legal = self._legal(frm, edge_labels, direction, None)
        if set(self.df.columns) != {frm, f"{frm}__label"} or len(labels) != 1 or not legal or any({s, d} != labels for s, _, d in legal) or (to_labels is not None and not labels <= set(to_labels)):
            return None
        edges = self._edge_frame(legal, direction, None, ()).select(F.col("_f").alias("src"), F.col("_t").alias("dst"))
        graph = held.hold(edges, counted=counted)
        if graph is None:
            return None
        starts, seen = measured(self.df.select(F.col(frm).alias("id")), {"n": F.count(F.lit(1))})
        if seen["n"] > held.HELD or starts.distinct().count() < seen["n"]:
            release(starts)
            return None
        sources = graph.numbers(starts)
        release(starts)
        return graph, sources

    def shortest_lengths(self, frm: str, to: str, upper: int | None = None, edge_labels: Iterable[str] | None = None, direction: str = OUT, to_labels: Iterable[str] | None = None, path: str = "_p", props: Iterable[str] = (), ends: bool = True) -> Rows:
        """Like `shortest` for one path of each pair, with its length as `path__length` and not its vertices. Without `ends`
        there is a row for each path all the same, but `to` may be missing."""
        found = None if to in self.df.columns else self._held(frm, edge_labels, direction, to_labels)
        if found is None:
            out = self.shortest(frm, to, upper, edge_labels, direction, to_labels, path, props=props)
            return out._with(out.df.withColumn(f"{path}__length", F.size(path) - 1).drop(path))
        graph, sources = found
        depth = None if upper is None else max(upper - 1, 0)
        (label,) = self.labels[frm]
        begin = [F.col("source").alias(frm), F.lit(label).alias(f"{frm}__label")]
        if not ends:
            d = held.amounts(self.df.sparkSession, graph, sources, depth).where("dist > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
            return self._with(d.select(*begin, F.col("dist").alias(f"{path}__length")), paths=self.paths | {path}, head=path)
        d = held.pairs(self.df.sparkSession, graph, sources, depth, least=1)
        df = d.select(*begin, F.col("id").alias(to), F.lit(label).alias(f"{to}__label"), F.col("dist").alias(f"{path}__length"))
        return self._with(df, labels={**self.labels, to: self.labels[frm]}, paths=self.paths | {path}, head=path).fetch(to, props)

    def path_counts(self, frm: str, to: str, hops: int, edge_labels: Iterable[str] | None = None, direction: str = OUT, option: str = "simple", name: str = "n") -> DataFrame:
        """`frm, to, name`: how many paths of so many hops, simple or trails, lead from each vertex to each.

        Paths of three hops are counted without listing them, where workers hold the graph.
        """
        found = self._held(frm, edge_labels, direction, None, counted=True) if hops == 3 and option in ("simple", "trail") and direction != BOTH else None
        if found is None:
            return self.path_expand(frm, to, hops, hops + 1, edge_labels, direction, option=option).df.groupBy(frm, to).agg(F.count(F.lit(1)).alias(name))
        return held.three_steps(self.df.sparkSession, *found, option == "simple").toDF(frm, to, name)

    # -- relational operators ----------------------------------------------------------------------------------
    def where(self, condition: Column) -> Rows:
        return self._with(self.df.where(truth(condition)))

    def columns_of(self, alias: str) -> list[str]:
        return [c for c in self.df.columns if c == alias or c.startswith(alias + "__")]

    def join(self, other: Rows, on: list[str] | None = None, how: str = "inner") -> Rows:
        """Joins on shared aliases: inner, left, right, full, left_semi, left_anti, or cross if nothing is shared."""
        keys = [a for a in (on if on is not None else self.aliases()) if a in other.df.columns]
        cols = [c for a in keys for c in (a, f"{a}__label") if c in self.df.columns and c in other.df.columns]
        extra = [c for c in other.df.columns if c in self.df.columns and c not in cols]
        right = other.df.drop(*extra)
        df = self.df.join(right, cols, how) if cols else self.df.crossJoin(right)
        if how in ("left_semi", "left_anti"):
            return self._with(df)
        return self._with(df, labels={**other.labels, **self.labels}, edges=self.edges | other.edges, paths=self.paths | other.paths)

    def aliases(self) -> list[str]:
        return [c for c in self.df.columns if "__" not in c]

    def dedup(self, keys: list[str]) -> Rows:
        return self._with(self.df.dropDuplicates([c for k in keys for c in (k, f"{k}__label") if c in self.df.columns]))

    def order(self, by: list[tuple[Column, bool]], offset: int = 0, limit: int | None = None) -> Rows:
        """Nulls come first in ascending order and last in descending order."""
        df = self.df.orderBy(*[c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in by]) if by else self.df
        df = df.offset(offset) if offset else df
        return self._with(df.limit(limit) if limit is not None else df)

    def unfold(self, column: Column, alias: str, outer: bool = False) -> Rows:
        return self._with(self.df.withColumn(alias, (F.explode_outer if outer else F.explode)(column)), head=alias)

    def union(self, *others: Rows) -> Rows:
        labels = {a: self.labels.get(a, frozenset()).union(*[o.labels.get(a, frozenset()) for o in others]) for a in self.labels}
        return self._with(union([self.df, *[o.df for o in others]]), labels=labels)

    def draw(self, seed: int = 0) -> Column:
        """A number in (0, 1) per row that depends on the row and the seed, not on the partitioning; equal rows draw alike."""
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in self.df.columns]), 11).cast("double") + 0.5) / float(1 << 53)

    def sample(self, fraction: float, seed: int = 0) -> Rows:
        """Each row with this chance, between 0 and 1."""
        if not 0 <= fraction <= 1:
            raise ValueError(f"a fraction is between 0 and 1, not {fraction}")
        return self._with(self.df.where(self.draw(seed) < fraction))

    def sample_n(self, n: int, seed: int = 0, weight: Column | None = None) -> Rows:
        """n rows at random, with chances in proportion to the weight if there is one (the sampling is the feature); null
        weights and those of 0 or less come last."""
        u = self.draw(seed)
        key = u if weight is None else F.when(weight > 0, -F.log(u) / weight)
        return self._with(self.df.withColumn("_k", key).orderBy(F.col("_k").asc_nulls_last()).limit(n).drop("_k"))

    def apply(self, keys: list[str], sub: Callable[[Rows], Rows], how: str = "left", aggregate: dict[str, Column] | None = None) -> Rows:
        """Correlated sub-query, decorrelated: it runs once over the distinct keys and is joined back.

        With `aggregate` the sub-rows of a key are folded; without, semi and anti only test for a sub-row.
        """
        cols = [c for k in keys for c in (k, f"{k}__label") if c in self.df.columns]
        base = self._with(self.df.select(*cols).distinct(), labels={k: v for k, v in self.labels.items() if k in keys})
        got = sub(base).df
        if aggregate:
            got = got.groupBy(*cols).agg(*[c.alias(n) for n, c in aggregate.items()])
        elif how in ("left_semi", "left_anti"):
            got = got.select(*cols).distinct()
        return self._with(self.df.join(got, cols, how))

    def segment_apply(self, keys: list[str], aggregates: dict[str, Column], sub: Callable[[Rows], Rows] | None = None) -> Rows:
        """A sub-plan per group of the keys: it runs over all rows at once, keeps the keys, and is folded per group."""
        cols = [c for k in keys for c in (k, f"{k}__label") if c in self.df.columns]
        got = self if sub is None else sub(self)
        return self._with(got.df.groupBy(*cols).agg(*[c.alias(n) for n, c in aggregates.items()]), labels={k: v for k, v in self.labels.items() if k in keys}, edges=frozenset(), paths=frozenset())

    def merge_tagged(self, **others: Rows) -> Rows:
        """The rows of several inputs in one, with the input's name in `tag` (`main` for these); columns one lacks are null."""
        return self._with(union([self.df.withColumn("tag", F.lit("main")), *[o.df.withColumn("tag", F.lit(t)) for t, o in others.items()]]))

    def switch(self, **conditions: Column) -> dict[str, Rows]:
        """Splits the rows: each goes to the first condition that holds, the others to `default`."""
        out, free = {}, F.lit(True)
        for name, c in conditions.items():
            out[name] = self.where(free & truth(c))
            free = free & ~truth(c)
        return {**out, "default": self.where(free)}

    def zip(self, other: Rows, by: list[Column], other_by: list[Column]) -> Rows:
        """Row by row with another input, both in the order given; what is longer is cut. Positions are counted per range
        of the order and added up, so that no task numbers all rows."""
        left, right = numbered(self.df, by, "_at"), numbered(other.df, other_by, "_at")
        clash = [c for c in right.columns if c in left.columns and c != "_at"]
        return self._with(left.join(right.drop(*clash), "_at").drop("_at"))


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """`df` with its position from 1 in an order, ties in any: range partitions, numbered each and shifted by those before."""
    names = [f"_by{i}" for i in range(len(by))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select("*", *[c.alias(n) for c, n in zip(by, names)]).repartitionByRange(parts, *names).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*names)).cast("long")))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))  # a row per partition
    return ranged.join(sizes.select("_part", "before"), "_part").withColumn(name, F.col(name) + F.col("before")).drop("_part", "before", *names)


def row_number(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
