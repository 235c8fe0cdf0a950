"""Property graphs as DataFrames: schema, mapping from tables, and operations that give new graphs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Triplet = tuple[str, str, str]  # source label, edge label, destination label


@dataclass(frozen=True)
class Graph:
    """Labelled multigraph. Vertex frames have `id` and properties, edge frames `src`, `dst` and properties.

    Every operation returns a new graph; frames are lazy. A vertex is identified by its label and id, an edge by its
    `eid` if it has that column, else by its triplet, ends and properties. Parallel edges that are equal in all of these
    are told apart only where it matters (trails, subgraphs), by `identified`.
    """

    vertices: dict[str, DataFrame]
    edges: dict[Triplet, DataFrame] = field(default_factory=dict)
    directed: bool = True

    # -- schema ------------------------------------------------------------------------------------------------
    def labels(self) -> list[str]:
        return sorted(self.vertices)

    def edge_labels(self) -> list[str]:
        return sorted({e for _, e, _ in self.edges})

    def properties(self, label: str) -> list[str]:
        return [c for c in self.vertices[label].columns if c != "id"]

    def edge_properties(self, label: str) -> list[str]:
        return sorted({c for t, df in self.edges.items() if t[1] == label for c in df.columns if c not in ("src", "dst")})

    def triplets(self, edge_labels: Iterable[str] | None = None, src: Iterable[str] | None = None, dst: Iterable[str] | None = None) -> list[Triplet]:
        """The legal triplets under label constraints: this is how unlabelled patterns get their labels."""
        e, s, d = (None if x is None else set(x) for x in (edge_labels, src, dst))
        return [t for t in sorted(self.edges) if (s is None or t[0] in s) and (e is None or t[1] in e) and (d is None or t[2] in d)]

    def schema(self, spark: SparkSession) -> DataFrame:
        """Metadata: `kind, label, source, destination, property, data_type`."""
        rows = [("vertex", v, None, None, c, t) for v, df in sorted(self.vertices.items()) for c, t in df.dtypes]
        rows += [("edge", e, s, d, c, t) for (s, e, d), df in sorted(self.edges.items()) for c, t in df.dtypes]
        return spark.createDataFrame(rows, "kind string, label string, source string, destination string, property string, data_type string")

    def statistics(self) -> DataFrame:
        """Number of vertices and edges per label (and ends)."""
        parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("kind"), F.lit(v).alias("label"), F.lit("").alias("ends"), "n") for v, df in sorted(self.vertices.items())]
        parts += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.lit(e).alias("label"), F.lit(f"{s}->{d}").alias("ends"), "n") for (s, e, d), df in sorted(self.edges.items())]
        return union(parts)

    # -- scans -------------------------------------------------------------------------------------------------
    def v(self, *labels: str) -> DataFrame:
        """Vertices of some labels (all, if none is given) as one frame with `label, id` and the union of properties."""
        return union([self.vertices[x].select(F.lit(x).alias("label"), "*") for x in (labels or self.labels())])

    def e(self, *labels: str) -> DataFrame:
        """Edges as one frame with `src_label, label, dst_label, src, dst` and the union of properties."""
        return union([self.edges[t].select(F.lit(t[0]).alias("src_label"), F.lit(t[1]).alias("label"), F.lit(t[2]).alias("dst_label"), "*") for t in self.triplets(labels or None)])

    # -- new graphs --------------------------------------------------------------------------------------------
    def project(self, vertices: dict[str, list[str] | None], edges: dict[str, list[str] | None]) -> Graph:
        """The labels named, with the properties named (None: all). Edges with a missing end label go too."""
        keep_v = {x: self.vertices[x] if p is None else self.vertices[x].select("id", *p) for x, p in vertices.items()}
        keep_e = {t: df if edges[t[1]] is None else df.select("src", "dst", *edges[t[1]]) for t, df in self.edges.items() if t[1] in edges and t[0] in keep_v and t[2] in keep_v}
        return Graph(keep_v, keep_e, self.directed)

    def simple(self, weight: str | None = None, edge_labels: list[str] | None = None, labelled: bool = False) -> DataFrame:
        """Edges of a simple graph: `src, dst, w` (1.0 without a weight, or where it is null).

        Ends are ids, which must then be unique over the labels used. labelled: over several labels they are structs
        (label, id), as two labels may use one id. All algorithms take either.
        """
        used = self.triplets(edge_labels)
        labels = {x for s, _, d in used for x in (s, d)}
        end = (lambda x, c: F.col(c)) if len(labels) == 1 or not labelled else (lambda x, c: F.struct(F.lit(x).alias("label"), F.col(c).alias("id")))
        w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
        return union([self.edges[t].select(end(t[0], "src").alias("src"), end(t[2], "dst").alias("dst"), w.alias("w")) for t in used])

    def run(self, algorithm: Callable[..., DataFrame], *args, weight: str | None = None, edge_labels: list[str] | None = None, **options) -> DataFrame:
        """An algorithm over all labels: its result with `label` and `id` of each vertex. A source is a (label, id)."""
        e = self.simple(weight, edge_labels, labelled=True)
        struct = isinstance(e.schema["src"].dataType, StructType)
        args = tuple(_vertex(e, a) if struct and isinstance(a, tuple) else a[1] if isinstance(a, tuple) else a for a in args)
        out = algorithm(e, *args, **options)
        labels = {x for s, _, d in self.triplets(edge_labels) for x in (s, d)}
        named = [F.col("id.label").alias("label"), F.col("id.id").alias("id")] if struct else [F.lit(next(iter(labels))).alias("label"), F.col("id")]
        return out.select(*named, *[c for c in out.columns if c != "id"])

    def identified(self, edge_labels: Iterable[str] | None = None) -> Graph:
        """The graph with an `eid` in the edges of some labels: equal edges are numbered, so that no two are alike."""
        es = dict(self.edges)
        for t in self.triplets(edge_labels):
            df = es[t]
            if "eid" not in df.columns:
                n = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_n"))  # equal edges meet as one row, and then spread again
                n = n.select("*", F.explode(F.sequence(F.lit(0), F.expr("_n div 65536"))).alias("_block"))
                block = F.sequence(F.col("_block") * 65536, F.least(F.col("_n"), F.col("_block") * 65536 + 65535))
                es[t] = n.select(*df.columns, F.explode(block).alias("_k")).select(*df.columns, F.xxhash64(*[F.lit(x) for x in t], *df.columns, "_k").alias("eid"))
        return Graph(self.vertices, es, self.directed)

    def flatten(self) -> Graph:
        """All labels merged into one, with the label kept as a property."""
        return Graph({"_": self.v()}, {("_", "_", "_"): self.e()}, self.directed)

    def add_vertices(self, label: str, df: DataFrame) -> Graph:
        """A new label, or more vertices of an existing one (missing properties are null)."""
        old = self.vertices.get(label)
        return Graph({**self.vertices, label: df if old is None else old.unionByName(df, allowMissingColumns=True)}, self.edges, self.directed)

    def add_edges(self, triplet: Triplet, df: DataFrame) -> Graph:
        old = self.edges.get(triplet)
        return Graph(self.vertices, {**self.edges, triplet: df if old is None else old.unionByName(df, allowMissingColumns=True)}, self.directed)

    def add_column(self, label: str, result: DataFrame, columns: dict[str, str]) -> Graph:
        """Attaches columns of an algorithm's result (by `id`) as properties: {property: result column}; null where absent."""
        r = result.select(F.col("id").alias("_rid"), *[F.col(c).alias(p) for p, c in columns.items()])
        v = self.vertices[label].drop(*columns)
        return Graph({**self.vertices, label: v.join(r, v["id"] == r["_rid"], "left").drop("_rid")}, self.edges, self.directed)

    def consolidate(self, label: str, columns: list[str], name: str) -> Graph:
        """Merges vertex properties into one list property."""
        v = self.vertices[label]
        return Graph({**self.vertices, label: v.withColumn(name, F.array(*columns)).drop(*[c for c in columns if c != name])}, self.edges, self.directed)

    def induce(self, label: str, ids: DataFrame) -> Graph:
        """The subgraph on some vertices of one label (column `id`); edges survive if their ends do."""
        ids = ids.select("id").distinct()
        vs = {**self.vertices, label: self.vertices[label].join(ids, "id", "left_semi")}
        es = {}
        for t, df in self.edges.items():
            for end, x in (("src", t[0]), ("dst", t[2])):
                if x == label:
                    df = df.join(ids.withColumnRenamed("id", end), end, "left_semi")
            es[t] = df
        return Graph(vs, es, self.directed)

    @staticmethod
    def from_edges(edges: dict[Triplet, DataFrame], vertices: dict[str, DataFrame] | None = None, directed: bool = True) -> Graph:
        """A graph from edge frames; vertex frames that aren't given are the ends of the edges."""
        vs = dict(vertices or {})
        found: dict[str, list[DataFrame]] = {}
        for (s, _, d), df in edges.items():
            found.setdefault(s, []).append(df.select(F.col("src").alias("id")))
            found.setdefault(d, []).append(df.select(F.col("dst").alias("id")))
        for x, parts in found.items():
            vs.setdefault(x, union(parts).distinct())
        return Graph(vs, dict(edges), directed)

    def remove_vertices(self, label: str, ids: DataFrame) -> Graph:
        """Without some vertices of a label (column `id`) and all edges that end at them."""
        ids = ids.select("id").distinct()
        es = {}
        for t, df in self.edges.items():
            for end, x in (("src", t[0]), ("dst", t[2])):
                if x == label:
                    df = df.join(ids.withColumnRenamed("id", end), end, "left_anti")
            es[t] = df
        return Graph({**self.vertices, label: self.vertices[label].join(ids, "id", "left_anti")}, es, self.directed)

    def remove_edges(self, triplet: Triplet, pairs: DataFrame) -> Graph:
        """Without the edges between some ends (columns `src, dst`)."""
        return Graph(self.vertices, {**self.edges, triplet: self.edges[triplet].join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")}, self.directed)

    def edge_subgraph(self, triplet: Triplet, edges: DataFrame) -> Graph:
        """The graph of some edges of a triplet and their ends, with the ends' properties."""
        s, _, d = triplet
        ends: dict[str, list[DataFrame]] = {}
        ends.setdefault(s, []).append(edges.select(F.col("src").alias("id")))
        ends.setdefault(d, []).append(edges.select(F.col("dst").alias("id")))
        return Graph({x: self.vertices[x].join(union(p).distinct(), "id", "left_semi") for x, p in ends.items()}, {triplet: edges}, self.directed)

    def reversed(self) -> Graph:
        flip = {(d, e, s): df.withColumnsRenamed({"src": "dst", "dst": "src"}) for (s, e, d), df in self.edges.items()}
        return Graph(self.vertices, flip, self.directed)

    def to_undirected(self) -> Graph:
        """Edges in both directions, each once; triplets between different labels get a reverse triplet."""
        es: dict[Triplet, DataFrame] = {}
        for (s, e, d), df in self.edges.items():
            back = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in df.columns if c not in ("src", "dst")])
            if s == d:
                es[s, e, d] = df.unionByName(back).distinct()
            else:
                es[s, e, d], es[d, e, s] = df, back
        return Graph(self.vertices, es, False)

    def to_directed(self) -> Graph:
        return Graph(self.vertices, self.edges if not self.directed else dict(self.edges), True)

    def clear_edges(self) -> Graph:
        return Graph(self.vertices, {t: df.where(F.lit(False)) for t, df in self.edges.items()}, self.directed)

    def copy(self) -> Graph:
        return Graph(dict(self.vertices), dict(self.edges), self.directed)

    def repartition(self, partitions: int) -> Graph:
        """Edges hash-partitioned by source, so that expansions from the same ends share a partitioning."""
        return Graph(self.vertices, {t: df.repartition(partitions, "src") for t, df in self.edges.items()}, self.directed)

    # -- storage -----------------------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        """An archive: a parquet folder per label or triplet, and the schema as JSON."""
        for x, df in self.vertices.items():
            df.write.mode("overwrite").parquet(f"{path}/v/{x}")
        for (s, e, d), df in self.edges.items():
            df.write.mode("overwrite").parquet(f"{path}/e/{s}__{e}__{d}")
        meta = json.dumps({"vertices": self.labels(), "edges": sorted(self.edges), "directed": self.directed})
        spark = next(iter(self.vertices.values())).sparkSession
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        meta = json.loads(spark.read.text(f"{path}/schema").first().value)
        es = {(s, e, d): spark.read.parquet(f"{path}/e/{s}__{e}__{d}") for s, e, d in meta["edges"]}
        return Graph({x: spark.read.parquet(f"{path}/v/{x}") for x in meta["vertices"]}, es, meta["directed"])

    # -- reports -----------------------------------------------------------------------------------------------
    def neighbors(self, triplet: Triplet, vid: object, out: bool = True) -> DataFrame:
        a, b = ("src", "dst") if out else ("dst", "src")
        return self.edges[triplet].where(F.col(a) == F.lit(vid)).select(F.col(b).alias("id")).distinct()

    def has_node(self, label: str, vid: object) -> bool:
        return not self.vertices[label].where(F.col("id") == F.lit(vid)).isEmpty()

    def has_edge(self, triplet: Triplet, src: object, dst: object) -> bool:
        return not self.edges[triplet].where((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))).isEmpty()

    def node_data(self, label: str, vid: object) -> DataFrame:
        """The properties of a vertex: one row, or none."""
        return self.vertices[label].where(F.col("id") == F.lit(vid)).drop("id")

    def edge_data(self, triplet: Triplet, src: object, dst: object) -> DataFrame:
        """The properties of the edges between two vertices, a row each."""
        return self.edges[triplet].where((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))).drop("src", "dst")

    def self_loops(self) -> DataFrame:
        return union([df.where("src = dst").select(F.lit(t[1]).alias("label"), "src", "dst") for t, df in self.edges.items() if t[0] == t[2]])


def _vertex(edges: DataFrame, at: tuple) -> Column:
    kind = edges.schema["src"].dataType
    return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(at, kind.fields)])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# -- selectors ---------------------------------------------------------------------------------------------------
_SELECTOR = re.compile(r"(v|e|r)(?::([\w-]+))?(?:\.([\w]+))?")


def select(graph: Graph, selectors: dict[str, str], label: str, result: DataFrame | None = None, vertex_range: tuple[str | None, str | None] | None = None) -> DataFrame:
    """A context's frame: column name -> selector (`v.id`, `v.label_id`, `v.prop`, `v:LABEL.prop`, `r`, `r.col`, `e.src`, `e.dst`, `e.prop`).

    Vertex selectors read the vertices of `label` joined with the result by id; `vertex_range` is half open and in the
    order of the ids as text.
    """
    parsed = {name: _SELECTOR.fullmatch(s) for name, s in selectors.items()}
    if bad := [s for n, s in selectors.items() if parsed[n] is None]:
        raise ValueError(f"not a selector: {bad[0]}")
    if all(m[1] == "e" for m in parsed.values()):
        rows = graph.e(label)
        return rows.select(*[F.col({"src": "src", "dst": "dst"}.get(m[3] or "src", m[3] or "src")).alias(n) for n, m in parsed.items()])
    label = next((m[2] for m in parsed.values() if m[2]), label)
    v = graph.vertices[label].alias("v")
    rows = v if result is None else v.join(result.alias("r"), F.col("v.id") == F.col("r.id"), "left")
    out: list[Column] = []
    for name, m in parsed.items():
        if m[1] == "v":
            c = F.lit(graph.labels().index(label)) if m[3] == "label_id" else F.col(f"v.{m[3] or 'id'}")
        else:
            value = m[3] or next(c for c in result.columns if c != "id")
            c = F.col(f"r.{value}")
        out.append(c.alias(name))
    if vertex_range:
        low, high = vertex_range
        text = F.col("v.id").cast("string")
        rows = rows.where((text >= low if low is not None else F.lit(True)) & (text < high if high is not None else F.lit(True)))
    return rows.select(*out)


# -- mapping from tables -----------------------------------------------------------------------------------------
@dataclass
class VertexMap:
    table: str
    key: str
    where: str | None = None


@dataclass
class EdgeMap:
    table: str
    src: str
    dst: str
    properties: dict[str, str] = field(default_factory=dict)
    distinct: bool = False
    count: str | None = None
    key: tuple[str, ...] = ()  # columns that tell all edges apart, for their eid; none: equal edges are numbered where it matters


def map_tables(tables: dict[str, DataFrame], vertices: dict[str, VertexMap], edges: dict[Triplet, EdgeMap]) -> Graph:
    """A graph over tables: keys become ids (integers widen to long), foreign keys edges. Rows with a null key or end are left out."""

    def key(df: DataFrame, c: str) -> Column:
        return F.col(c).cast("long") if dict(df.dtypes)[c] in ("int", "smallint", "tinyint") else F.col(c)

    vs = {}
    for x, m in vertices.items():
        df = tables[m.table] if m.where is None else tables[m.table].where(m.where)
        vs[x] = df.where(F.col(m.key).isNotNull()).select(key(df, m.key).alias("id"), *[c for c in df.columns if c != m.key])
    es = {}
    for t, m in edges.items():
        df = tables[m.table].where(F.col(m.src).isNotNull() & F.col(m.dst).isNotNull())
        df = df.select(key(df, m.src).alias("src"), key(df, m.dst).alias("dst"), *[F.col(c).alias(p) for p, c in m.properties.items()], *([F.xxhash64(*[F.lit(x) for x in t], *m.key).alias("eid")] if m.key else []))
        if m.count:
            df = df.groupBy("src", "dst").agg(F.count(F.lit(1)).alias(m.count))
        elif m.distinct:
            df = df.distinct()
        es[t] = df
    return Graph(vs, es)


def trade_graph(spark: SparkSession, d: str) -> Graph:
    """The order tables of a data directory as a graph."""
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    vs = {
        "REGION": VertexMap("region", "r_regionkey"),
        "NATION": VertexMap("nation", "n_nationkey"),
        "CUSTOMER": VertexMap("customer", "c_custkey"),
        "SUPPLIER": VertexMap("supplier", "s_suppkey"),
        "PART": VertexMap("part", "p_partkey"),
        "ORDERS": VertexMap("orders", "o_orderkey"),
    }
    es = {
        ("NATION", "IN_REGION", "REGION"): EdgeMap("nation", "n_nationkey", "n_regionkey"),
        ("CUSTOMER", "IN_NATION", "NATION"): EdgeMap("customer", "c_custkey", "c_nationkey"),
        ("SUPPLIER", "IN_NATION", "NATION"): EdgeMap("supplier", "s_suppkey", "s_nationkey"),
        ("CUSTOMER", "PLACED", "ORDERS"): EdgeMap("orders", "o_custkey", "o_orderkey", {"orderdate": "o_orderdate"}),
        ("ORDERS", "CONTAINS", "PART"): EdgeMap("lineitem", "l_orderkey", "l_partkey", {"quantity": "l_quantity", "price": "l_extendedprice", "shipdate": "l_shipdate"}),
        ("ORDERS", "FROM_SUPPLIER", "SUPPLIER"): EdgeMap("lineitem", "l_orderkey", "l_suppkey"),
        ("SUPPLIER", "SUPPLIES", "PART"): EdgeMap("lineitem", "l_suppkey", "l_partkey", count="n"),
    }
    return map_tables(tables, vs, es)


def film_graph(spark: SparkSession, d: str) -> Graph:
    """The film tables of a data directory as a graph; rows delivered twice count once."""
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("person_name", "title", "cast_info", "movie_keyword")}
    tables["cast"] = tables["cast_info"].select("id", "person_id", "movie_id", "role_id", "nr_order").distinct()
    tables["keyword"] = tables["movie_keyword"].select("keyword_id").where("keyword_id is not null").distinct()
    tables["tagged"] = tables["movie_keyword"].select("id", "movie_id", "keyword_id").distinct()
    vs = {"NAME": VertexMap("person_name", "id"), "TITLE": VertexMap("title", "id"), "KEYWORD": VertexMap("keyword", "keyword_id")}
    es = {
        ("NAME", "CAST_INFO", "TITLE"): EdgeMap("cast", "person_id", "movie_id", {"role": "role_id", "nr": "nr_order"}),
        ("TITLE", "MOVIE_KEYWORD", "KEYWORD"): EdgeMap("tagged", "movie_id", "keyword_id"),
        ("TITLE", "EPISODE_OF", "TITLE"): EdgeMap("title", "id", "episode_of_id"),
    }
    return map_tables(tables, vs, es)
