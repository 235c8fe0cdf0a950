"""Gremlin to DataFrames over the same operators as Cypher.

A traversal is read into steps; each step moves the head (the alias of the current element or value). Tags are aliases.
Sub-traversals in where, not and by run once over the distinct heads and are joined back.

Result columns: an element gives `id, label`; values give the property's name; select gives the tags; aggregates give
count, sum, min, max, mean or fold; group gives keys `k0, k1, ...` and values `v0, v1, ...`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..graph import union as union_frames
from .expressions import ExpressionParser, Lowering, Tokens, literal, walk
from .rows import BOTH, IN, OUT, Rows, truth

_MODULATORS = {"by", "with"}
_AGGREGATES = {"count", "sum", "min", "max", "mean", "fold"}


class Reader:
    """Traversal text to steps: (name, args), args being ("lit", v), ("steps", [...]), ("pred", name, args), ("word", name) or ("expr", e)."""

    def __init__(self, text: str) -> None:
        self.t = Tokens(text)

    def steps(self) -> list:
        out = []
        if self.t.peek()[1] in ("g", "__"):
            self.t.next()
            self.t.need(".")
        while True:
            name = self.t.name()
            out.append((name, self.args(name)))
            if not self.t.take("."):
                return out

    def args(self, step: str) -> list:
        self.t.need("(")
        out: list = []
        if step == "expr":
            e = ExpressionParser(self.t).expression()
            out.append(("expr", e))
            while self.t.take(","):
                out.append(("expr", ExpressionParser(self.t).expression()))
            self.t.need(")")
            return out
        while not self.t.take(")"):
            out.append(self.arg())
            self.t.take(",")
        return out

    def arg(self):
        t = self.t
        sign = -1 if t.take("-") else 1
        kind, text = t.peek()
        if kind in ("num", "str"):
            t.next()
            v = literal(kind, text)
            return ("lit", v * sign if kind == "num" else v)
        if text in ("true", "false"):
            t.next()
            return ("lit", text == "true")
        if t.take("["):
            items = []
            while not t.take("]"):
                items.append(self.arg()[1])
                t.take(",")
            return ("lit", items)
        if text in ("P", "TextP", "T", "Order", "Column", "Pop", "Scope") and t.peek(1) == ("op", "."):
            t.next(), t.next()
            kind, text = t.peek()
        if t.peek(1) == ("op", "(") and text in PREDICATES:
            return self.predicate()
        if text in ("g", "__") or t.peek(1) == ("op", "("):
            if text == "expr":
                t.next()
                return self.args("expr")[0]
            return ("steps", self.steps())
        t.next()
        return ("word", text)

    def predicate(self):
        name = self.t.name()
        self.t.need("(")
        args = []
        while not self.t.take(")"):
            args.append(self.predicate_arg())
            self.t.take(",")
        p = ("pred", name, args)
        while self.t.peek() == ("op", ".") and self.t.peek(1)[1] in ("and", "or"):
            self.t.next()
            link = self.t.name()
            self.t.need("(")
            other = self.arg()
            self.t.need(")")
            p = ("pred", link, [p, other])
        return p

    def predicate_arg(self):
        a = self.arg()
        return a if a[0] == "pred" else a[1]


def _in(c: Column, args: list) -> Column:
    return c.isin(args[0] if len(args) == 1 and isinstance(args[0], list) else args)


PREDICATES = {
    "eq": lambda c, a: c == a[0],
    "neq": lambda c, a: c != a[0],
    "lt": lambda c, a: c < a[0],
    "lte": lambda c, a: c <= a[0],
    "gt": lambda c, a: c > a[0],
    "gte": lambda c, a: c >= a[0],
    "within": _in,
    "without": lambda c, a: ~_in(c, a),
    "inside": lambda c, a: (c > a[0]) & (c < a[1]),
    "outside": lambda c, a: (c < a[0]) | (c > a[1]),
    "containing": lambda c, a: c.contains(a[0]),
    "notContaining": lambda c, a: ~c.contains(a[0]),
    "startingWith": lambda c, a: c.startswith(a[0]),
    "notStartingWith": lambda c, a: ~c.startswith(a[0]),
    "endingWith": lambda c, a: c.endswith(a[0]),
    "notEndingWith": lambda c, a: ~c.endswith(a[0]),
    "not": lambda c, a: ~test(c, a[0]),
}


def test(c: Column, p) -> Column:
    """A predicate (or plain value) on a column."""
    if p[0] == "lit":
        return c == p[1]
    _, name, args = p
    if name in ("and", "or"):
        x, y = truth(test(c, args[0])), truth(test(c, args[1]))
        return x & y if name == "and" else x | y
    return PREDICATES[name](c, args)


class Traversal:
    """Runs steps over rows; `names` are the property names that occur in the text."""

    def __init__(self, graph: Graph, names: set[str], counter: list[int] | None = None) -> None:
        self.graph, self.names, self.n = graph, names, counter if counter is not None else [0]
        self.origin: dict[str, str] = {}  # edge alias -> the vertex it was reached from

    def alias(self) -> str:
        self.n[0] += 1
        return f"h{self.n[0]}"

    def edge_props(self) -> list[str]:
        return sorted({p for e in self.graph.edge_labels() for p in self.graph.edge_properties(e)} & self.names)

    def fetch(self, rows: Rows, alias: str, *props: str) -> Rows:
        return rows.fetch(alias, props) if alias in rows.labels else rows

    def prop(self, rows: Rows, alias: str, p: str) -> Column:
        if f"{alias}__{p}" in rows.df.columns:
            return F.col(f"{alias}__{p}")
        return F.col(alias) if p in ("id", "~id") else F.lit(None)

    # -- steps -------------------------------------------------------------------------------------------------
    def run(self, rows: Rows | None, steps: list) -> Rows:
        i = 0
        while i < len(steps):
            name, args = steps[i]
            mods = []
            while i + 1 < len(steps) and steps[i + 1][0] in _MODULATORS:
                i += 1
                mods.append(steps[i])
            rows = self.step(rows, name, args, mods)
            i += 1
        return rows

    def step(self, rows: Rows | None, name: str, args: list, mods: list) -> Rows:
        lits = [a[1] for a in args if a[0] == "lit"]
        lits = lits[0] if len(lits) == 1 and isinstance(lits[0], list) else lits
        head = rows.head if rows is not None else None
        if name in ("V", "E"):
            a = self.alias()
            rows = Rows.scan(self.graph, a) if name == "V" else Rows.scan_edges(self.graph, a, None, self.edge_props())
            return rows.where(F.col(a).isin(lits)) if lits else rows
        if name in ("identity", "barrier"):
            return rows
        if name == "as":
            return self.rename(rows, head, lits[0])
        if name == "hasLabel":
            out = rows.where(F.col(f"{head}__label").isin(lits))
            return out._with(out.df, labels={**out.labels, head: out.labels[head] & frozenset(lits)}) if head in out.labels else out
        if name in ("hasId", "id") and (name == "hasId" or not args):
            if name == "hasId":
                return rows.where(test(F.col(head), args[0]) if args[0][0] == "pred" else F.col(head).isin(lits))
            return self.value(rows, "id", F.col(head))
        if name == "label":
            return self.value(rows, "label", F.col(f"{head}__label"))
        if name == "has":
            if len(args) == 3:
                rows, args = self.step(rows, "hasLabel", args[:1], []), args[1:]
            key = args[0][1]
            if key in ("id", "label"):
                c = F.col(head) if key == "id" else F.col(f"{head}__label")
            else:
                rows = self.fetch(rows, head, key)
                c = self.prop(rows, head, key)
            return rows.where(test(c, args[1]) if len(args) > 1 else c.isNotNull())
        if name == "hasNot":
            rows = self.fetch(rows, head, args[0][1])
            return rows.where(self.prop(rows, head, args[0][1]).isNull())
        if name in ("out", "in", "both"):
            return self.expand(rows, name, lits, mods)
        if name in ("outE", "inE", "bothE"):
            a, b = self.alias(), self.alias()
            direction = {"outE": OUT, "inE": IN, "bothE": BOTH}[name]
            out = rows.expand(head, b, lits or None, direction, edge=a, edge_props=self.edge_props())
            self.origin[a] = head
            return out._with(out.df, head=a)
        if name in ("outV", "inV", "otherV", "bothV"):
            which = {"outV": "start", "inV": "end", "otherV": "other", "bothV": "both"}[name]
            a = self.alias()
            out = rows.get_v(head, a, which, self.origin.get(head))
            found = {x for t in self.graph.edges for x in (t[0], t[2])}
            return out._with(out.df, labels={**out.labels, a: out.labels[a] & frozenset(found)})
        if name == "endV":
            return rows._with(rows.df, head=self.origin.get(head, head))
        if name in ("limit", "range"):
            low, high = (0, lits[0]) if name == "limit" else lits
            return rows._with((rows.df.offset(low) if low else rows.df).limit(high - low))
        if name == "dedup":
            return self.dedup(rows, lits, mods)
        if name == "order":
            return self.order(rows, mods)
        if name == "select":
            return self.select(rows, args, mods)
        if name in ("values",):
            rows = self.fetch(rows, head, *lits)
            out = self.value(rows, lits[0], self.prop(rows, head, lits[0]))
            return out.where(F.col(out.head).isNotNull())
        if name in ("valueMap", "elementMap"):
            return self.maps(rows, name, lits)
        if name == "is":
            return rows.where(test(F.col(head), args[0]))
        if name == "constant":
            return self.value(rows, "constant", F.lit(lits[0]))
        if name == "where":
            return self.where(rows, args, mods)
        if name == "not":
            return self.exists(rows, args[0][1], "left_anti")
        if name == "union":
            parts = [self.sub().run(rows, a[1]) for a in args]
            a = self.alias()
            return self.rename(parts[0], parts[0].head, a).union(*[self.rename(p, p.head, a) for p in parts[1:]])
        if name == "coin":
            return rows.sample(*lits[:2])
        if name == "sample":
            weight = None
            for _, m in mods:
                rows = self.fetch(rows, head, m[0][1])
                weight = self.prop(rows, head, m[0][1])
            return rows.sample_n(lits[0], 0, weight)
        if name == "unfold":
            a = self.alias()
            return rows.unfold(F.col(head), a)
        if name == "match":
            return self.match(rows, [a[1] for a in args])
        if name in ("group", "groupCount"):
            return self.group(rows, name, mods)
        if name in _AGGREGATES:
            c = self.aggregate(rows, name)
            return Rows(self.graph, rows.df.agg(c.alias(name)), head=name)
        if name == "expr":
            return self.value(rows, "expr", self.expression(rows, args[0][1]))
        if name == "subgraph":
            return rows
        raise SyntaxError(f"unknown step {name}")

    def sub(self) -> Traversal:
        t = Traversal(self.graph, self.names, self.n)
        t.origin = self.origin
        return t

    def rename(self, rows: Rows, old: str, new: str) -> Rows:
        if old == new:
            return rows
        df = rows.df.withColumnsRenamed({c: new + c[len(old) :] for c in rows.columns_of(old)})
        labels = {new if k == old else k: v for k, v in rows.labels.items()}
        edges = frozenset(new if e == old else e for e in rows.edges)
        paths = frozenset(new if e == old else e for e in rows.paths)
        self.origin = {new if k == old else k: new if v == old else v for k, v in self.origin.items()}
        return rows._with(df, labels=labels, edges=edges, paths=paths, head=new)

    def value(self, rows: Rows, name: str, c: Column) -> Rows:
        return rows._with(rows.df.withColumn(f"val_{name}", c), head=f"val_{name}")

    def expand(self, rows: Rows, name: str, lits: list, mods: list) -> Rows:
        to, head = self.alias(), rows.head
        if lits and isinstance(lits[0], str) and ".." in lits[0]:
            low, high = (int(x) for x in lits[0].split(".."))
            options = {a[0][1]: a[1] for _, a in mods}
            option = options.get("PATH_OPT", ("lit", "ARBITRARY"))[1].lower()
            result = options.get("RESULT_OPT", ("lit", "END_V"))[1]
            whole = result != "END_V"
            until = options.get("UNTIL")
            path = self.alias() if whole else None
            cond = None
            if until is not None:
                e = ExpressionParser(Tokens(until[1].removeprefix("expr(").removesuffix(")"))).expression() if until[0] == "lit" else until[1]
                cond = lambda end: Lowering(rows._with(rows.df, labels={**rows.labels, end: rows.labels[head]}))(self.on_head(e, end))
            out = rows.path_expand(head, to, low, high, lits[1:] or None, name, option=option, path=path, until=cond, path_edges=() if result == "ALL_V_E" else None)
            if path:
                self.origin[path] = to
            if result == "ALL_V_E":  # vertices and edges in turn, an edge as its label and ends
                v = F.transform(path, lambda x: F.struct(x["label"], x["id"], F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("dst")))
                none = F.lit(None).cast("bigint").alias("id")
                es = F.transform(f"{path}__edges", lambda x: F.struct(x["label"], none, x["src"].cast("bigint").alias("src"), x["dst"].cast("bigint").alias("dst")))
                both = F.flatten(F.zip_with(v, es, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
                out = out._with(out.df.withColumn(path, both).drop(f"{path}__edges"))
            return out
        return rows.expand(head, to, lits or None, name)

    def on_head(self, e, head: str):
        """An expression in which a bare `@.x` or `_.x` stands for the head."""
        if e[0] == "prop" and e[1] in ("", "_"):
            return ("var", head) if e[2] in ("id", "~id") else ("prop", head, e[2])
        if e[0] == "var" and e[1] in ("", "_"):
            return ("var", head)
        if e[0] == "op":
            return ("op", e[1], [self.on_head(x, head) for x in e[2]])
        if e[0] == "call":
            return ("call", e[1], [self.on_head(x, head) for x in e[2]], e[3], e[4])
        return e

    def expression(self, rows: Rows, e) -> Column:
        return Lowering(self.fetched(rows, e))(self.on_head(e, rows.head))

    def fetched(self, rows: Rows, e) -> Rows:
        for x in walk(self.on_head(e, rows.head)):
            if x[0] == "prop" and x[1] in rows.labels:
                rows = rows.fetch(x[1], [x[2]])
        return rows

    def by(self, rows: Rows, alias: str, args: list) -> tuple[Rows, Column]:
        """The rows with, and the value of, one by() applied to an alias."""
        if not args or args[0][0] == "word" and args[0][1] in ("asc", "desc", "incr", "decr", "shuffle"):
            return rows, F.col(alias)
        a = args[0]
        if a[0] == "lit":
            rows = self.fetch(rows, alias, a[1])
            return rows, self.prop(rows, alias, a[1])
        if a[0] == "word":
            return rows, F.col(alias) if a[1] == "id" else F.col(f"{alias}__label")
        if a[0] == "expr":
            rows = self.fetched(rows, a[1])
            return rows, Lowering(rows)(self.on_head(a[1], alias))
        steps = a[1]
        if steps[0][0] in ("values", "id", "label") and len(steps) == 1:
            key = steps[0][1][0][1] if steps[0][0] == "values" else steps[0][0]
            return self.by(rows, alias, [("lit", key)] if key not in ("id", "label") else [("word", key)])
        col = self.alias()
        last = steps[-1][0]
        keys = rows.columns_of(alias)[:2] if alias in rows.labels else [alias]
        base = rows._with(rows.df.select(*keys).distinct(), head=alias, labels={k: v for k, v in rows.labels.items() if k == alias})
        got = self.sub().run(base, steps[:-1] if last in _AGGREGATES else steps)
        agg = self.aggregate(got, last) if last in _AGGREGATES else F.min(got.head)
        found = got.df.groupBy(*keys).agg(agg.alias(col))
        df = rows.df.join(found, keys, "left")
        if last == "count":
            df = df.withColumn(col, F.coalesce(col, F.lit(0)))
        return rows._with(df), F.col(col)

    def order(self, rows: Rows, mods: list) -> Rows:
        by = []
        for _, m in mods or [("by", [])]:
            words = [a[1] for a in m if a[0] == "word"]
            if "shuffle" in words:
                by.append((rows.draw(), True))
                continue
            rows, c = self.by(rows, rows.head, m)
            by.append((c, not {"desc", "decr"} & set(words)))
        head = rows.head
        return rows.order(by)._with(rows.order(by).df, head=head)

    def dedup(self, rows: Rows, tags: list, mods: list) -> Rows:
        aliases = tags or [rows.head]
        if not mods:
            return rows.dedup(aliases)
        cols = []
        for k, (_, m) in enumerate(mods):
            rows, c = self.by(rows, aliases[min(k, len(aliases) - 1)], m)
            name = f"_d{k}"
            rows, cols = rows._with(rows.df.withColumn(name, c)), [*cols, name]
        return rows._with(rows.df.dropDuplicates(cols).drop(*cols))

    def select(self, rows: Rows, args: list, mods: list) -> Rows:
        if args and args[0][0] == "expr":
            rows = self.fetched(rows, args[0][1])
            return self.value(rows, "expr", Lowering(rows)(self.on_head(args[0][1], rows.head)))
        if args and args[0][0] == "word":
            keep = [c for c in rows.df.columns if c.startswith("k" if args[0][1] == "keys" else "v")]
            return Rows(self.graph, rows.df.select(*keep), head=keep[0])
        tags = [a[1] for a in args]
        if len(tags) == 1 and not mods:
            return rows._with(rows.df, head=tags[0])
        for k, tag in enumerate(tags):
            m = mods[k % len(mods)][1] if mods else []
            rows, c = self.by(rows, tag, m)
            rows = rows._with(rows.df.withColumn(f"sel_{tag}", c))
        return rows._with(rows.df, head=f"sel_{tags[0]}" if len(tags) == 1 else "sel_")

    def maps(self, rows: Rows, name: str, keys: list) -> Rows:
        head = rows.head
        props = keys or sorted({p for x in rows.labels.get(head, ()) for p in self.graph.properties(x)})
        rows = self.fetch(rows, head, *props)
        cols = [self.prop(rows, head, p).alias(p) for p in props]
        if name == "elementMap":
            cols = [F.col(head).alias("id"), F.col(f"{head}__label").alias("label"), *cols]
        return self.value(rows, name, F.struct(*cols))

    def exists(self, rows: Rows, steps: list, how: str) -> Rows:
        head = rows.head
        keys = [head] if head not in rows.labels else [head]
        tags = [a[1] for n, args in steps for a in args if n == "as" and a[1] in rows.df.columns]
        out = rows.apply(list(dict.fromkeys([*keys, *tags])), lambda base: self.sub().run(base._with(base.df, head=head), steps), how)
        return out._with(out.df, head=head)

    def where(self, rows: Rows, args: list, mods: list) -> Rows:
        a = args[0]
        if a[0] == "steps":
            steps = a[1]
            if steps[0][0] == "not":
                return self.exists(rows, steps[0][1][0][1], "left_anti")
            return self.exists(rows, steps, "left_semi")
        if a[0] == "expr":
            rows = self.fetched(rows, a[1])
            return rows.where(Lowering(rows)(self.on_head(a[1], rows.head)))
        left, pred = (a[1], args[1]) if a[0] == "lit" else (rows.head, a)
        sides = [left, pred[2][0]]
        cols = []
        for k, alias in enumerate(sides):
            m = mods[min(k, len(mods) - 1)][1] if mods else []
            rows, c = self.by(rows, alias, m)
            if not mods and alias in rows.labels:
                c = F.struct(F.col(f"{alias}__label"), F.col(alias))
            cols.append(c)
        return rows.where(PREDICATES[pred[1]](cols[0], [cols[1]]))

    def match(self, rows: Rows, sentences: list) -> Rows:
        """Sentences joined on their tags; `not` ones exclude."""
        left = list(sentences)
        first = left[0][0][1][0][1]
        rows = self.rename(rows, rows.head, first)
        while left:
            s = next(x for x in left if x[0][0] in ("as", "not") and (x[0][0] == "not" or x[0][1][0][1] in rows.df.columns))
            left.remove(s)
            if s[0][0] == "not":
                inner = s[0][1][0][1]
                tag = inner[0][1][0][1]
                rows = self.exists(rows._with(rows.df, head=tag), inner[1:], "left_anti")
                continue
            tag, end = s[0][1][0][1], s[-1][1][0][1] if s[-1][0] == "as" else None
            body = s[1:-1] if end else s[1:]
            moved = self.sub().run(rows._with(rows.df, head=tag), body)
            if end and end in rows.df.columns:
                new = moved.head
                same = (F.col(new) == F.col(end)) & (F.col(f"{new}__label") == F.col(f"{end}__label"))
                rows = moved.where(same)._with(moved.where(same).df.drop(*moved.columns_of(new)), head=end)
            else:
                rows = self.rename(moved, moved.head, end) if end else moved
        return rows

    def aggregate(self, rows: Rows, name: str) -> Column:
        c = F.col(rows.head) if rows.head in rows.df.columns else F.lit(1)
        return {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "mean": lambda: F.avg(c), "fold": lambda: F.array_sort(F.collect_list(c))}[name]()

    def group(self, rows: Rows, name: str, mods: list) -> Rows:
        """The first by() has the keys, the second the values; both may hold several."""
        head = rows.head
        keys, cols = (mods[0][1] if mods else []), []
        for k, a in enumerate(keys or [None]):
            rows, c = self.by(rows, a[1][0][1][0][1] if a and a[0] == "steps" and a[1][0][0] == "select" else head, [] if a is None else self._after_select(a))
            rows = rows._with(rows.df.withColumn(f"k{k}", c))
            cols.append(f"k{k}")
        aggs: list[Column] = []
        values = mods[1][1] if len(mods) > 1 else []
        if name == "groupCount":
            aggs = [F.count(F.lit(1)).alias("v0")]
        elif not values:
            aggs = [F.array_sort(F.collect_list(head)).alias("v0")]
        for k, a in enumerate(values if name == "group" else []):
            steps = a[1] if a[0] == "steps" else [("values", [a])]
            steps = [s for s in steps if s[0] != "as"]
            target, distinct, agg, c = head, False, "fold", None
            for s, sargs in steps:
                if s == "select":
                    target = sargs[0][1]
                elif s == "values":
                    rows = self.fetch(rows, target, sargs[0][1])
                    c = self.prop(rows, target, sargs[0][1])
                elif s == "dedup":
                    distinct = True
                elif s in _AGGREGATES:
                    agg = s
                elif s not in ("id",):
                    rows, c = self.by(rows, target, [("steps", steps)])
                    agg = "max"
            c = F.col(target) if c is None else c
            made = {"count": (F.count_distinct if distinct else F.count), "sum": F.sum_distinct if distinct else F.sum, "min": F.min, "max": F.max, "mean": F.avg, "fold": lambda x, d=distinct: F.array_sort(F.collect_set(x) if d else F.collect_list(x))}[agg]
            aggs.append(made(c).alias(f"v{k}"))
        return Rows(self.graph, rows.df.groupBy(*cols).agg(*aggs), head="k0")

    def _after_select(self, a) -> list:
        if a[0] == "steps" and a[1][0][0] == "select":
            return [("steps", a[1][1:])] if len(a[1]) > 1 else []
        return [a]


def _steps(text: str) -> tuple[list, set[str]]:
    steps = Reader(text).steps()
    return steps, {literal(k, x) for k, x in Tokens(text).items if k == "str"} | {x for k, x in Tokens(text).items if k == "name"}


def gremlin(graph: Graph, text: str) -> DataFrame:
    """The result of a Gremlin traversal."""
    steps, names = _steps(text)
    rows = Traversal(graph, names).run(None, steps)
    head, df = rows.head, rows.df
    if head in rows.labels or head in rows.edges:
        return df.select(F.col(head).alias("id"), F.col(f"{head}__label").alias("label"))
    if head and head.startswith("sel_"):
        sel = [c for c in df.columns if c.startswith("sel_")]
        return df.select(*[F.col(c).alias(c[4:]) for c in sel])
    if head and head.startswith("val_"):
        return df.select(F.col(head).alias(head[4:]))
    return df.select(head) if head in rows.paths or head not in ("k0",) and head in df.columns and head not in _AGGREGATES else df


def subgraph(graph: Graph, text: str) -> Graph:
    """The graph of the edges that a traversal ends with, each by its own identity, and their ends."""
    steps, names = _steps(text)
    told = graph.identified()
    rows = Traversal(told, names).run(None, [s for s in steps if s[0] != "subgraph"])
    e = rows.head
    own = rows.df.select(F.col(e).alias("eid")).distinct()
    edges, ends = {}, {}
    for t in sorted(rows.triplets_of(e)):
        found = told.edges[t].join(own, "eid", "left_semi")
        edges[t] = found.select(*graph.edges[t].columns)
        ends.setdefault(t[0], []).append(found.select(F.col("src").alias("id")))
        ends.setdefault(t[2], []).append(found.select(F.col("dst").alias("id")))
    return Graph({x: graph.vertices[x].join(union_frames(p).distinct(), "id", "left_semi") for x, p in ends.items()}, edges, graph.directed)
