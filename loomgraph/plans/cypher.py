"""Cypher to DataFrames: clauses are read one by one and lowered to graph operators at once.

Labels of unlabelled variables come from the schema; a vertex's properties are scanned or joined only if the query uses
them. Patterns are homomorphic: variables may bind the same element. Hop ranges are half open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, union
from ..operators import algorithms
from .expressions import ExpressionParser, Lowering, Tokens, has_aggregate, walk
from .rows import BOTH, IN, OUT, Rows, truth

_END = ("MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "CALL", "ORDER", "LIMIT", "UNION", "SKIP", "CREATE")


@dataclass
class Node:
    var: str
    labels: list[str] | None
    props: dict = field(default_factory=dict)


@dataclass
class Rel:
    var: str | None
    labels: list[str] | None
    direction: str
    hops: tuple[int, int | None] | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Path:
    var: str | None
    nodes: list[Node]
    rels: list[Rel]
    shortest: str | None = None


#: CALL procedures: name -> function of (graph, *args) that gives a DataFrame.
PROCEDURES: dict[str, Callable[..., DataFrame]] = {}


def procedure(name: str, function: Callable[..., DataFrame]) -> None:
    PROCEDURES[name] = function


class Cypher:
    """One query over one graph."""

    def __init__(self, graph: Graph, text: str, params: dict | None = None) -> None:
        self.graph, self.params = graph, params or {}
        self.t = Tokens(text)
        self.e = ExpressionParser(self.t, self.maybe_path)
        self.fresh = 0
        self.used = self._uses(text)
        self.edges_asked = "relationships(" in text

    def _uses(self, text: str) -> dict[str, list[str]]:
        """Properties by variable, wherever the text says variable.property."""
        out: dict[str, list[str]] = {}
        items = Tokens(text).items
        for k in range(len(items) - 2):
            if items[k][0] == "name" and items[k + 1] == ("op", ".") and items[k + 2][0] == "name":
                out.setdefault(items[k][1].strip("`"), []).append(items[k + 2][1].strip("`"))
        return {a: list(dict.fromkeys(p)) for a, p in out.items()}

    def anonymous(self) -> str:
        self.fresh += 1
        return f"anon{self.fresh}"

    # -- patterns ----------------------------------------------------------------------------------------------
    def labels(self) -> list[str] | None:
        if not self.t.take(":"):
            return None
        out = [self.t.name()]
        while self.t.take("|"):
            self.t.take(":")
            out.append(self.t.name())
        return out

    def props(self) -> dict:
        out = {}
        if self.t.take("{"):
            while not self.t.take("}"):
                key = self.t.name()
                self.t.need(":")
                out[key] = self.e.expression()
                self.t.take(",")
        return out

    def node(self) -> Node:
        self.t.need("(")
        var = self.t.name() if self.t.peek()[0] == "name" else self.anonymous()
        n = Node(var, self.labels(), self.props())
        self.t.need(")")
        return n

    def rel(self) -> Rel:
        left = self.t.take("<-")
        if not left:
            if not self.t.take("-"):
                self.t.need("->")
                return Rel(None, None, OUT)
        var = labels = hops = None
        props: dict = {}
        if self.t.take("["):
            if self.t.peek()[0] == "name":
                var = self.t.name()
            labels = self.labels()
            if self.t.take("*"):
                low = high = None
                if self.t.peek()[0] == "num":
                    low = int(self.t.next()[1])
                if self.t.take(".."):
                    if self.t.peek()[0] == "num":
                        high = int(self.t.next()[1])
                    else:
                        self.t.take("*")
                elif low is not None:
                    high = low + 1
                hops = (1 if low is None else low, high)
            props = self.props()
            self.t.need("]")
        right = self.t.take("->")
        if not right:
            self.t.need("-")
        return Rel(var, labels, IN if left and not right else OUT if right and not left else BOTH, hops, props)

    def path(self) -> Path:
        var = None
        if self.t.peek()[0] == "name" and self.t.peek(1) == ("op", "="):
            var = self.t.name()
            self.t.need("=")
        every = self.t.word("ALL")
        if self.t.is_word("SHORTESTPATH", "ALLSHORTESTPATHS"):
            every = self.t.next()[1].upper() != "SHORTESTPATH" or every
            self.t.need("(")
            p = self.chain()
            self.t.need(")")
            p.var, p.shortest = var or self.anonymous(), "all" if every else "any"
            return p
        p = self.chain()
        p.var = var
        return p

    def chain(self) -> Path:
        nodes, rels = [self.node()], []
        while self.t.peek() in (("op", "-"), ("op", "<-"), ("op", "->")):
            rels.append(self.rel())
            nodes.append(self.node())
        return Path(None, nodes, rels)

    def maybe_path(self) -> Path | None:
        p = self.chain()
        return p if p.rels else None

    # -- lowering of patterns ----------------------------------------------------------------------------------
    def filters(self, rows: Rows, var: str, props: dict) -> Rows:
        low = Lowering(rows, self.params)
        for k, v in props.items():
            rows = rows.where(low.prop(var, k) == low(v))
        return rows

    def wanted(self, n: Node, rows: Rows | None = None) -> list[str]:
        """Properties of a vertex that the query uses and its labels have."""
        labels = n.labels or self.graph.labels()
        have = {p for x in labels for p in self.graph.properties(x)}
        return [p for p in dict.fromkeys([*self.used.get(n.var, []), *n.props]) if p in have]

    def match_path(self, rows: Rows | None, p: Path) -> Rows:
        nodes, rels = p.nodes, p.rels
        if rows is None or not any(n.var in rows.df.columns for n in nodes):
            start = nodes[0]
            begun = self.filters(Rows.scan(self.graph, start.var, start.labels, self.wanted(start)), start.var, start.props)
            if rows is None:
                rows = self.walk_right(begun, nodes, rels, 0, p)
            else:
                rows = rows.join(self.walk_right(begun, nodes, rels, 0, p))
            return rows
        at = next(i for i, n in enumerate(nodes) if n.var in rows.df.columns)
        rows = self.filters(rows.fetch(nodes[at].var, nodes[at].props) if nodes[at].var in rows.labels else rows, nodes[at].var, nodes[at].props)
        for i in range(at, 0, -1):
            r = rels[i - 1]
            flip = {OUT: IN, IN: OUT, BOTH: BOTH}[r.direction]
            rows = self.step(rows, nodes[i], Rel(r.var, r.labels, flip, r.hops, r.props), nodes[i - 1], p)
        return self.walk_right(rows, nodes, rels, at, p)

    def walk_right(self, rows: Rows, nodes: list[Node], rels: list[Rel], at: int, p: Path) -> Rows:
        for i in range(at, len(rels)):
            rows = self.step(rows, nodes[i], rels[i], nodes[i + 1], p)
        if p.var and not p.shortest and p.var not in rows.df.columns:
            parts = [F.array(F.struct(F.col(f"{n.var}__label").alias("label"), F.col(n.var).alias("id"))) for n in nodes]
            rows = rows._with(rows.df.withColumn(p.var, F.concat(*parts)), paths=rows.paths | {p.var})
        return rows

    def step(self, rows: Rows, a: Node, r: Rel, b: Node, p: Path) -> Rows:
        new = b.var not in rows.df.columns
        if p.shortest:
            upper = r.hops[1] if r.hops else None  # without an upper bound: as long as it takes
            if p.shortest == "any" and self.only_length(p.var):
                rows = rows.shortest_lengths(a.var, b.var, upper, r.labels, r.direction, b.labels, p.var, self.wanted(b), ends=bool(b.props) or [x for _, x in self.t.items].count(b.var) > 1)
            else:
                rows = rows.shortest(a.var, b.var, upper, r.labels, r.direction, b.labels, p.var, p.shortest == "all", self.wanted(b))
        elif r.hops:
            if r.hops[1] is None:
                raise ValueError("a path without an upper bound needs shortestPath")
            single = p.var if len(p.rels) == 1 else None
            where = (lambda e: self.edge_filter(e, r)) if r.props else None
            name = single or r.var
            have = {p for x in (r.labels or self.graph.edge_labels()) for p in self.graph.edge_properties(x)}
            edges = sorted(have) if name and self.edges_asked else None
            rows = rows.path_expand(a.var, b.var, r.hops[0], r.hops[1], r.labels, r.direction, b.labels, path=name, props=self.wanted(b), edge_where=where, edge_props=list(r.props), path_edges=edges)
        else:
            var = r.var or (self.anonymous() if r.props else None)
            props = list(dict.fromkeys([*self.used.get(r.var or "", []), *r.props]))
            rows = rows.expand(a.var, b.var, r.labels, r.direction, b.labels, var, props, self.wanted(b))
            if r.props:
                rows = self.filters(rows, var, r.props)
        return self.filters(rows, b.var, b.props) if new or b.props else rows

    def only_length(self, path: str) -> bool:
        """Whether the query asks for nothing of a path but `length(path)`."""
        words = [x for _, x in self.t.items]
        if any(x.upper() in ("RETURN", "WITH", "DISTINCT") and y == "*" for x, y in zip(words, words[1:])):
            return False
        at = [i for i, x in enumerate(words) if x == path]
        return all(words[i + 1 : i + 2] == ["="] and words[i + 2].upper() == "SHORTESTPATH" or [x.lower() for x in words[max(i - 2, 0) : i]] == ["length", "("] and words[i + 1 : i + 2] == [")"] for i in at)

    def edge_filter(self, e: str, r: Rel):
        out = F.lit(True)
        for k, v in r.props.items():
            out = out & (F.col(f"{e}__{k}") == Lowering(Rows(self.graph, next(iter(self.graph.vertices.values()))), self.params)(v))
        return out

    # -- conditions --------------------------------------------------------------------------------------------
    def where(self, rows: Rows, e) -> Rows:
        """Conjuncts one by one; path patterns become semi joins, and negated ones anti joins."""
        if e[0] == "op" and e[1] == "and":
            return self.where(self.where(rows, e[2][0]), e[2][1])
        negated, inner = (True, e[2][0]) if e[0] == "op" and e[1] == "not" else (False, e)
        if inner[0] == "pattern":
            p: Path = inner[1]
            shared = [n.var for n in p.nodes if n.var in rows.df.columns]
            return rows.apply(list(dict.fromkeys(shared)), lambda base: self.match_path(base, p), "left_anti" if negated else "left_semi")
        return rows.where(Lowering(self.fetched(rows, e), self.params)(e)) if self.fetched(rows, e) is rows else self.fetched(rows, e).where(Lowering(self.fetched(rows, e), self.params)(e))

    def fetched(self, rows: Rows, *exprs) -> Rows:
        """The rows with all vertex properties that some expressions use."""
        for e in exprs:
            for x in walk(e):
                if x[0] == "prop" and x[1] in rows.labels and f"{x[1]}__{x[2]}" not in rows.df.columns and x[2] not in ("id", "_id"):
                    rows = rows.fetch(x[1], [x[2]])
        return rows

    # -- clauses -----------------------------------------------------------------------------------------------
    def match(self, rows: Rows | None, optional: bool) -> Rows:
        paths = [self.path()]
        while self.t.take(","):
            paths.append(self.path())
        cond = self.e.expression() if self.t.word("WHERE") else None
        if not optional or rows is None:
            for p in self.ordered(rows, paths):
                rows = self.match_path(rows, p)
            return rows if cond is None else self.where(rows, cond)
        shared = {n.var for p in paths for n in p.nodes} | {x[1] for x in (walk(cond) if cond else ()) if x[0] in ("var", "prop")}
        keys = [a for a in rows.aliases() if a in shared]
        cols = [c for a in keys for c in rows.columns_of(a)]
        sub = Rows(self.graph, rows.df.select(*cols).distinct(), {a: s for a, s in rows.labels.items() if a in keys}, rows.edges & set(keys))
        for p in self.ordered(sub, paths):
            sub = self.match_path(sub, p)
        sub = sub if cond is None else self.where(sub, cond)
        right = sub.df.select(*[F.col(c).alias(f"_k_{c}") if c in cols else F.col(c) for c in sub.df.columns])
        on = F.lit(True)
        for c in cols:
            on = on & rows.df[c].eqNullSafe(right[f"_k_{c}"])
        return rows._with(rows.df.join(right, on, "left").drop(*[f"_k_{c}" for c in cols]), labels={**sub.labels, **rows.labels}, edges=rows.edges | sub.edges, paths=rows.paths | sub.paths)

    def ordered(self, rows: Rows | None, paths: list[Path]) -> list[Path]:
        """Patterns so that each touches what is bound already, if any does."""
        bound, left, out = set(rows.df.columns) if rows else set(), list(paths), []
        while left:
            nxt = next((p for p in left if any(n.var in bound for n in p.nodes)), left[0])
            left.remove(nxt)
            out.append(nxt)
            bound |= {n.var for n in nxt.nodes}
        return out

    def items(self) -> tuple[bool, list[tuple[object, str]], bool]:
        distinct = self.t.word("DISTINCT")
        if self.t.take("*"):
            return distinct, [], True
        out = []
        while True:
            at = self.t.i
            e = self.e.expression()
            text = "".join(x for _, x in self.t.items[at : self.t.i])
            out.append((e, self.t.name() if self.t.word("AS") else text.replace(".", "_") if e[0] == "prop" else text))
            if not self.t.take(","):
                return distinct, out, False

    def project(self, rows: Rows | None, final: bool) -> Rows:
        distinct, items, star = self.items()
        order: list[tuple[object, bool]] = []
        if self.t.word("ORDER", "BY"):
            while True:
                e = self.e.expression()
                up = not (self.t.word("DESC") or self.t.word("DESCENDING"))
                self.t.word("ASC")
                self.t.word("ASCENDING")
                order.append((e, up))
                if not self.t.take(","):
                    break
        skip = int(self.number()) if self.t.word("SKIP") else 0
        limit = int(self.number()) if self.t.word("LIMIT") else None
        cond = self.e.expression() if not final and self.t.word("WHERE") else None
        if star:
            items = [(("var", a), a) for a in rows.aliases()]
        rows = self.fetched(rows, *[e for e, _ in items], *[e for e, _ in order if not any(has_aggregate(i) for i, _ in items)])
        low = Lowering(rows, self.params)
        keys = [(e, n) for e, n in items if not has_aggregate(e)]
        labels, edges, paths, keep = {}, set(), set(), []
        for e, n in keys:  # vertices, edges and paths stay what they are
            if e[0] == "var" and (e[1] in rows.labels or e[1] in rows.edges or e[1] in rows.paths):
                keep += [F.col(c).alias(n + c[len(e[1]) :]) for c in rows.columns_of(e[1])]
                labels |= {n: rows.labels[e[1]]} if e[1] in rows.labels else {}
                edges |= {n} if e[1] in rows.edges else set()
                paths |= {n} if e[1] in rows.paths else set()
            else:
                keep.append(low(e).alias(n))
        ordered_before: list = []
        if len(keys) < len(items):
            calls: list = []
            outer = [(self.lift(e, calls), n) for e, n in items if has_aggregate(e)]
            aggs = [low(c).alias(f"_agg{k}") for k, c in enumerate(calls)]
            named = [f"_k{i}" for i in range(len(keep))]
            grouped = rows.df.groupBy(*[c.alias(k) for c, k in zip(keep, named)]).agg(*aggs)
            names = [n for n in rows.df.select(*keep).columns]
            df = grouped.select(*[F.col(k).alias(n) for k, n in zip(named, names)], *[F.col(f"_agg{k}") for k in range(len(calls))])
            tmp = Rows(self.graph, df, labels, frozenset(edges), frozenset(paths))
            low2 = Lowering(tmp, self.params)
            df = df.select(*names, *[low2(e).alias(n) for e, n in outer])
        else:
            df = rows.df.select(*keep, *[self.order_key(low, e, items, False).alias(f"_ord{i}") for i, (e, _) in enumerate(order)] if order and not distinct else [])
            ordered_before = [(F.col(f"_ord{i}"), up) for i, (_, up) in enumerate(order)] if order and not distinct else []
        out = Rows(self.graph, df.distinct() if distinct else df, labels, frozenset(edges), frozenset(paths))
        if ordered_before:
            out = out.order(ordered_before, skip, limit)
            out = out._with(out.df.drop(*[c for c in out.df.columns if c.startswith("_ord")]))
        elif order or skip or limit is not None:
            by = [(self.order_key(Lowering(out, self.params), e, items), up) for e, up in order]
            out = out.order(by, skip, limit)
        if cond is not None:
            out = self.where(out, cond)
        if final:
            out = out._with(out.df.select(*[F.col(f"`{n}`") for _, n in items]))
        return out

    def order_key(self, low: Lowering, e, items, projected: bool = True):
        for x, n in items:  # an item may be named by its expression or its alias, which hides a variable of that name
            if x == e or e == ("var", n):
                return F.col(f"`{n}`") if projected else low(x)
        return low(e)

    def lift(self, e, calls: list):
        """The expression with its aggregates replaced by columns."""
        if e[0] == "call" and e[1].lower() in ("count", "sum", "min", "max", "avg", "mean", "collect", "fold", "first"):
            if e not in calls:
                calls.append(e)
            return ("var", f"_agg{calls.index(e)}")
        if e[0] == "op":
            return ("op", e[1], [self.lift(x, calls) for x in e[2]])
        if e[0] == "call":
            return ("call", e[1], [self.lift(x, calls) for x in e[2]], e[3], e[4])
        if e[0] == "case":
            return ("case", e[1] and self.lift(e[1], calls), [(self.lift(a, calls), self.lift(b, calls)) for a, b in e[2]], self.lift(e[3], calls))
        return e

    def number(self):
        kind, text = self.t.next()
        return self.params[text[1:]] if kind == "param" else int(text)

    def call(self, rows: Rows | None) -> Rows:
        if self.t.take("{"):
            parts = [self.subquery(rows)]
            while self.t.word("UNION"):
                self.t.word("ALL")
                self.t.word("CALL")
                self.t.need("{")
                parts.append(self.subquery(rows))
            out = parts[0].union(*parts[1:])
            return out if rows is None else rows.join(out)
        name = self.t.name()
        while self.t.take("."):
            name += "." + self.t.name()
        args = []
        if self.t.take("("):
            while not self.t.take(")"):
                e = self.e.expression()
                args.append(self.params[e[1]] if e[0] == "param" else -e[2][0][1] if e[0] == "op" else e[1])
                self.t.take(",")
        df = PROCEDURES[name](self.graph, *args)
        if self.t.word("YIELD") and not self.t.take("*"):
            names = [self.t.name()]
            while self.t.take(","):
                names.append(self.t.name())
            df = df.select(*names)
        out = Rows(self.graph, df)
        return out if rows is None else rows.join(out)

    def create(self, rows: Rows | None) -> Rows:
        """Adds vertices and edges for every row: new ones have one label and an `id` among their properties."""
        if rows is None:
            rows = Rows(self.graph, next(iter(self.graph.vertices.values())).sparkSession.range(1).select(F.lit(1).alias("_root")))
        while True:
            p = self.path()
            for n in p.nodes:
                if n.var in rows.df.columns:
                    continue
                if not n.labels or len(n.labels) != 1 or "id" not in n.props:
                    raise ValueError(f"a new vertex needs one label and an id: {n.var}")
                rows = self.fetched(rows, *n.props.values())
                low, label = Lowering(rows, self.params), n.labels[0]
                old = self.graph.vertices.get(label)
                key = low(n.props["id"]) if old is None else low(n.props["id"]).cast(old.schema["id"].dataType)
                self.graph = self.graph.add_vertices(label, rows.df.select(key.alias("id"), *[low(v).alias(k) for k, v in n.props.items() if k != "id"]))
                rows = Rows(self.graph, rows.df.withColumn(n.var, key).withColumn(f"{n.var}__label", F.lit(label)), {**rows.labels, n.var: frozenset({label})}, rows.edges, rows.paths)
            for a, r, b in zip(p.nodes, p.rels, p.nodes[1:]):
                if not r.labels or len(r.labels) != 1 or r.direction == BOTH:
                    raise ValueError("a new edge needs one type and a direction")
                rows = self.fetched(rows, *r.props.values())
                low = Lowering(rows, self.params)
                s, d = (a.var, b.var) if r.direction == OUT else (b.var, a.var)
                made = rows.df.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(f"{s}__label").alias("_s"), F.col(f"{d}__label").alias("_d"), *[low(v).alias(k) for k, v in r.props.items()])
                for x in sorted(rows.labels[s]):
                    for y in sorted(rows.labels[d]):
                        self.graph = self.graph.add_edges((x, r.labels[0], y), made.where((F.col("_s") == x) & (F.col("_d") == y)).drop("_s", "_d"))
            if not self.t.take(","):
                return rows

    def subquery(self, rows: Rows | None) -> Rows:
        imported = rows
        if rows is not None and self.t.word("WITH"):
            names = [self.t.name()]
            while self.t.take(","):
                names.append(self.t.name())
            cols = [c for a in names for c in rows.columns_of(a)]
            imported = Rows(self.graph, rows.df.select(*cols).distinct(), {a: s for a, s in rows.labels.items() if a in names}, rows.edges & set(names))
        elif rows is not None:
            imported = None
        out = self.clauses(imported)
        self.t.need("}")
        return out

    def clauses(self, rows: Rows | None) -> Rows:
        while self.t.peek()[0] != "end" and self.t.peek() not in (("op", "}"), ("op", ";")):
            if self.t.word("OPTIONAL", "MATCH"):
                rows = self.match(rows, True)
            elif self.t.word("MATCH"):
                rows = self.match(rows, False)
            elif self.t.word("WHERE"):
                rows = self.where(rows, self.e.expression())
            elif self.t.word("WITH"):
                rows = self.project(rows, False)
            elif self.t.word("UNWIND"):
                if rows is None:
                    spark = next(iter(self.graph.vertices.values())).sparkSession
                    rows = Rows(self.graph, spark.range(1).select(F.lit(1).alias("_root")))
                e = self.e.expression()
                if not self.t.word("AS"):
                    raise SyntaxError("expected AS")
                rows = rows.unfold(Lowering(rows, self.params)(e), self.t.name())
            elif self.t.word("CALL"):
                rows = self.call(rows)
            elif self.t.word("CREATE"):
                rows = self.create(rows)
            elif self.t.word("RETURN"):
                rows = self.project(rows, True)
                if self.t.word("UNION"):
                    self.t.word("ALL")
                    return rows.union(self.clauses(None))
                return rows
            else:
                raise SyntaxError(f"unexpected {self.t.peek()[1]!r}")
        return rows


def cypher(graph: Graph, text: str, **params) -> DataFrame:
    """The result of a Cypher query."""
    return Cypher(graph, text, params).clauses(None).df


def execute(graph: Graph, text: str, **params) -> Graph:
    """The graph after a query with CREATE clauses."""
    q = Cypher(graph, text, params)
    q.clauses(None)
    return q.graph


def create(graph: Graph, label: str, df: DataFrame) -> Graph:
    """CREATE of vertices: a new graph that has them too."""
    return graph.add_vertices(label, df)


procedure("gs.procedure.meta.schema", lambda g: g.schema(next(iter(g.vertices.values())).sparkSession))
procedure("gs.procedure.meta.statistics", lambda g: g.statistics())
procedure("count_vertices", lambda g, label: g.v(label).agg(F.count(F.lit(1)).alias("n")))
procedure("k_hop_neighbors", lambda g, label, vid, k: Rows.scan(g, "a", [label]).where(F.col("a") == F.lit(vid)).path_expand("a", "b", 1, k + 1, direction=BOTH).df.select(F.col("b__label").alias("label"), F.col("b").alias("id")).distinct())
procedure(
    "pagerank",
    lambda g, src, dst, edge, damping=0.85, max_iter=20, epsilon=1e-6, limit=100: Graph({x: g.vertices[x] for x in (src, dst)}, {(src, edge, dst): g.edges[src, edge, dst]})
    .run(lambda e: algorithms.pagerank(e, _all_vertices(g, e, src, dst), damping, max_iter, epsilon))
    .orderBy(F.desc("rank"), "label", "id")
    .limit(limit),
)
procedure(
    "shortest_path_among_three",
    lambda g, label, a, b, c: _among_three(g, label, (a, b, c)),
)


def _all_vertices(graph: Graph, edges: DataFrame, *labels: str) -> DataFrame:
    """`id` of all vertices of some labels, in the form that the ends of `edges` have."""
    parts = [graph.vertices[x].select("id" if len(set(labels)) == 1 else F.struct(F.lit(x).alias("label"), "id").alias("id")) for x in dict.fromkeys(labels)]
    return union(parts)


def _among_three(graph: Graph, label: str, ids: tuple) -> DataFrame:
    """Length of the shortest walk that visits three vertices, over the orders of the three."""
    es = algorithms.both(graph.simple(edge_labels=sorted({e for s, e, d in graph.triplets(None, [label], [label])})))
    spark = es.sparkSession
    d = algorithms._multi_source(es, spark.createDataFrame([(i,) for i in ids], f"id {dict(graph.vertices[label].dtypes)['id']}"), False)
    pairs = d.where(F.col("id").isin(list(ids)) & (F.col("source") < F.col("id"))).select("dist")
    return pairs.agg(F.count(F.lit(1)).alias("k"), F.sum("dist").alias("s"), F.max("dist").alias("m")).select(F.when(F.col("k") == 3, F.col("s") - F.col("m")).alias("length"))
