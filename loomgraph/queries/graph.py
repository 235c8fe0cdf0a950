"""Queries of the graph operators, Cypher texts and algorithms, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, film_graph, select, trade_graph
from ..operators import algorithms as al
from ..plans.cypher import cypher, execute
from ..plans.gremlin import subgraph
from ..plans.rows import Rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _g(name: str, sql: str, f: Callable[[Graph], DataFrame], graph: Callable[[SparkSession, str], Graph] = trade_graph) -> None:
    _add(name, sql, lambda spark, d: f(graph(spark, d)))


def _c(name: str, text: str, sql: str, graph: Callable[[SparkSession, str], Graph] = trade_graph, **params) -> None:
    _add(name, sql, lambda spark, d: cypher(graph(spark, d), text, **params))


# -- operators ---------------------------------------------------------------------------------------------------
_g("g_scan_label", "SELECT s_suppkey AS a, s_name AS name FROM supplier", lambda g: Rows.scan(g, "a", ["SUPPLIER"], ["s_name"]).df.select("a", F.col("a__s_name").alias("name")))
_g(
    "g_scan_multi_label",
    "SELECT 'NATION' AS label, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'REGION', r_regionkey::BIGINT FROM region",
    lambda g: g.v("NATION", "REGION").select("label", "id"),
)
_g("g_scan_pk", "SELECT p_partkey AS a, p_brand AS brand FROM part WHERE p_partkey IN (1, 2, 3, 99)", lambda g: Rows.scan(g, "a", ["PART"], ["p_brand"]).where(F.col("a").isin(1, 2, 3, 99)).df.select("a", F.col("a__p_brand").alias("brand")))
_g("g_scan_count", "SELECT count(*) AS n FROM orders", lambda g: g.vertices["ORDERS"].agg(F.count(F.lit(1)).alias("n")))
_g(
    "g_expand_out",
    "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    lambda g: Rows.scan(g, "c", ["CUSTOMER"], ["c_mktsegment"]).where(F.col("c__c_mktsegment") == "BUILDING").expand("c", "o", ["PLACED"]).df.select("c", "o"),
)
_g("g_expand_in", "SELECT n_nationkey::BIGINT AS n, c_custkey AS x FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey::BIGINT, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey", lambda g: Rows.scan(g, "n", ["NATION"]).expand("n", "x", ["IN_NATION"], "in").df.select("n", "x"))
_g(
    "g_expand_both",
    "SELECT n_nationkey::BIGINT AS n, 'REGION' AS label, n_regionkey::BIGINT AS x FROM nation UNION ALL SELECT s_nationkey::BIGINT, 'SUPPLIER', s_suppkey FROM supplier",
    lambda g: Rows.scan(g, "n", ["NATION"]).expand("n", "x", ["IN_REGION", "IN_NATION"], "both", ["REGION", "SUPPLIER"]).df.select("n", F.col("x__label").alias("label"), "x"),
)
_g("g_expand_degree", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda g: Rows.scan(g, "c", ["CUSTOMER"]).degree("c", "n", ["PLACED"]).df.select("c", "n"))
_g(
    "g_expand_optional",
    "SELECT p_partkey AS p, l_orderkey AS o FROM part LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 49) ON l_partkey = p_partkey",
    lambda g: Rows.scan(Graph(g.vertices, {t: (df.where("quantity > 49") if t[1] == "CONTAINS" else df) for t, df in g.edges.items()}), "p", ["PART"]).expand("p", "o", ["CONTAINS"], "in", optional=True).df.select("p", "o"),
)
_g(
    "g_expand_edge_pred",
    "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_quantity > 45",
    lambda g: Rows.scan(g, "o", ["ORDERS"]).expand("o", "p", ["CONTAINS"], edge="e", edge_props=["quantity"]).where(F.col("e__quantity") > 45).df.select("o", "p", F.col("e__quantity").alias("q")),
)
_g(
    "g_getv_other",
    "SELECT s_suppkey AS s, s_nationkey::BIGINT AS n FROM supplier",
    lambda g: Rows.scan(g, "s", ["SUPPLIER"]).expand("s", "x", ["IN_NATION"], edge="e").get_v("e", "n", "other", "s").df.select("s", "n"),
)
_g(
    "g_getv_both",
    "SELECT x AS v, count(*) AS k FROM (SELECT unnest([n_nationkey, n_regionkey])::BIGINT AS x FROM nation) GROUP BY 1",
    lambda g: Rows.scan_edges(g, "e", ["IN_REGION"]).get_v("e", "v", "both").df.groupBy("v").agg(F.count(F.lit(1)).alias("k")),
)


def _users(spark: SparkSession, d: str) -> DataFrame:
    """A simple weighted graph of users: from a user to the one of the next event of the same type and day."""
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lag("user_id").over(w).alias("src"), F.col("user_id").alias("dst")).where("src is not null and src <> dst")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


_E = """ev AS (SELECT user_id, lag(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS prev FROM events),
e AS MATERIALIZED (SELECT prev AS src, user_id AS dst, count(*)::DOUBLE AS w FROM ev WHERE prev IS NOT NULL AND prev <> user_id GROUP BY ALL),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), nv AS (SELECT count(*)::DOUBLE AS n FROM v),
dg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY 1)"""
_U = _E + """, u AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL),
ud AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM u GROUP BY 1)"""


def _user_graph(spark: SparkSession, d: str) -> Graph:
    """All transitions between users."""
    return Graph.from_edges({("USER", "NEXT", "USER"): _users(spark, d)})


_P = f"WITH {_E}, h AS MATERIALIZED (SELECT src, dst FROM e)"
_g("g_path_1_3_arbitrary", f"{_P} SELECT src AS a, dst AS b FROM h UNION ALL SELECT x.src, y.dst FROM h x JOIN h y ON x.dst = y.src", lambda g: Rows.scan(g, "a", ["USER"]).path_expand("a", "b", 1, 3, ["NEXT"]).df.select("a", "b"), _user_graph)
_g(
    "g_path_simple",
    f"{_P} SELECT x.src AS a, z.dst AS b, count(*) AS n FROM h x JOIN h y ON x.dst = y.src JOIN h z ON y.dst = z.src WHERE x.src <> y.dst AND x.src <> z.dst AND x.dst <> z.dst GROUP BY ALL",
    lambda g: Rows.scan(g, "a", ["USER"]).path_counts("a", "b", 3, ["NEXT"], option="simple"),
    _user_graph,
)
_g(
    "g_path_trail",
    f"{_P} SELECT x.src AS a, z.dst AS b, count(*) AS n FROM h x JOIN h y ON x.dst = y.src JOIN h z ON y.dst = z.src WHERE NOT (x.src = z.src AND x.dst = z.dst) GROUP BY ALL",
    lambda g: Rows.scan(g, "a", ["USER"]).path_counts("a", "b", 3, ["NEXT"], option="trail"),
    _user_graph,
)
_g(
    "g_shortest_length",
    f"""{_P}, s1 AS (SELECT DISTINCT src AS a, dst AS b, 1 AS k FROM h),
    s2 AS (SELECT DISTINCT s.a, h.dst AS b, 2 AS k FROM s1 s JOIN h ON s.b = h.src WHERE h.dst <> s.a AND NOT EXISTS (SELECT 1 FROM s1 q WHERE q.a = s.a AND q.b = h.dst)),
    s3 AS (SELECT DISTINCT s.a, h.dst AS b, 3 AS k FROM s2 s JOIN h ON s.b = h.src WHERE h.dst <> s.a AND NOT EXISTS (SELECT 1 FROM s1 q WHERE q.a = s.a AND q.b = h.dst) AND NOT EXISTS (SELECT 1 FROM s2 q WHERE q.a = s.a AND q.b = h.dst))
    SELECT a, b, k FROM s1 UNION ALL SELECT a, b, k FROM s2 UNION ALL SELECT a, b, k FROM s3""",
    lambda g: Rows.scan(g, "a", ["USER"]).shortest_lengths("a", "b", 4, ["NEXT"], path="p").df.select("a", "b", F.col("p__length").alias("k")),
    _user_graph,
)
_g(
    "g_all_shortest",
    f"""{_P}, s1 AS (SELECT DISTINCT src AS a, dst AS b FROM h), s2 AS (SELECT s.a, h.dst AS b, count(*) AS n FROM s1 s JOIN h ON s.b = h.src WHERE h.dst <> s.a AND NOT EXISTS (SELECT 1 FROM s1 q WHERE q.a = s.a AND q.b = h.dst) GROUP BY ALL)
    SELECT a, b, 1::BIGINT AS n FROM s1 UNION ALL SELECT a, b, n FROM s2""",
    lambda g: Rows.scan(g, "a", ["USER"]).shortest("a", "b", 3, ["NEXT"], path="p", every=True).df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")),
    _user_graph,
)
_g("g_triangle", f"{_P} SELECT count(*) AS n FROM h x JOIN h y ON x.dst = y.src JOIN h z ON y.dst = z.src AND z.dst = x.src", lambda g: Rows.scan(g, "a", ["USER"]).expand("a", "b", ["NEXT"]).expand("b", "c", ["NEXT"]).expand("c", "a", ["NEXT"]).df.agg(F.count(F.lit(1)).alias("n")), _user_graph)

_g(
    "g_trail_parallel",
    "WITH l AS MATERIALIZED (SELECT l_orderkey, l_partkey, row_number() OVER () AS k FROM lineitem) SELECT x.l_orderkey AS o, count(*) AS n FROM l x JOIN l y USING (l_partkey) WHERE x.k <> y.k GROUP BY 1",
    lambda g: Rows.scan(g, "o", ["ORDERS"]).path_expand("o", "x", 2, 3, ["CONTAINS"], "both", option="trail").df.groupBy("o").agg(F.count(F.lit(1)).alias("n")),
)
_g(
    "g_path_optional",
    "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    lambda g: Rows.scan(g, "c", ["CUSTOMER"]).path_expand("c", "o", 1, 2, ["PLACED"], optional=True).df.select("c", "o"),
)
_g(
    "g_subgraph",
    "SELECT l_orderkey AS src, l_partkey AS dst, l_quantity AS quantity, l_extendedprice AS price, l_shipdate AS shipdate FROM lineitem WHERE l_quantity > 48",
    lambda g: subgraph(g, "g.E().hasLabel('CONTAINS').has('quantity', gt(48)).subgraph('x')").edges["ORDERS", "CONTAINS", "PART"].drop("eid"),
)
_g(
    "g_segment_apply",
    "SELECT c_nationkey AS n, count(o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    lambda g: Rows.scan(g, "c", ["CUSTOMER"], ["c_nationkey"]).segment_apply(["c__c_nationkey"], {"orders": F.count("o")}, lambda r: r.expand("c", "o", ["PLACED"])).df.select(F.col("c__c_nationkey").alias("n"), "orders"),
)
_g(
    "g_create",
    "SELECT s_suppkey AS src, c_custkey AS dst, s_acctbal AS since FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 0",
    lambda g: execute(g, "MATCH (s:SUPPLIER)-[:IN_NATION]->(n:NATION)<-[:IN_NATION]-(c:CUSTOMER) WHERE c.c_mktsegment = 'BUILDING' AND s.s_acctbal > 0 CREATE (s)-[:KNOWS {since: s.s_acctbal}]->(c)").edges["SUPPLIER", "KNOWS", "CUSTOMER"],
)
_g(
    "a_wcc_labelled",
    "SELECT label, count(*) AS n FROM (SELECT 'NATION' AS label FROM nation UNION ALL SELECT 'REGION' FROM region UNION ALL SELECT 'CUSTOMER' FROM customer UNION ALL SELECT 'SUPPLIER' FROM supplier) GROUP BY 1",
    lambda g: g.run(al.wcc, edge_labels=["IN_NATION", "IN_REGION"]).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
)
_g(
    "a_sssp_labelled",
    "SELECT 'NATION' AS label, 0::BIGINT AS id, 0.0::DOUBLE AS distance UNION ALL SELECT 'REGION', n_regionkey::BIGINT, 1.0 FROM nation WHERE n_nationkey = 0",
    lambda g: g.run(al.sssp, ("NATION", 0), edge_labels=["IN_NATION", "IN_REGION"]).where("distance is not null"),
)

_L = "SELECT c_custkey AS k, c_nationkey AS n FROM customer"
_R = "SELECT s_suppkey AS k, s_nationkey AS m FROM supplier"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _g(f"g_join_{_how}", f"SELECT k, n, m FROM ({_L}) {_sql} ({_R}) USING (k)", lambda g, how=_how: _sides(g)[0].join(_sides(g)[1], ["k"], how).df.select("k", "n", "m"))
_g("g_join_semi", f"SELECT k, n FROM ({_L}) SEMI JOIN ({_R}) USING (k)", lambda g: _sides(g)[0].join(_sides(g)[1], ["k"], "left_semi").df.select("k", "n"))
_g("g_join_anti", f"SELECT k, n FROM ({_L}) ANTI JOIN ({_R}) USING (k)", lambda g: _sides(g)[0].join(_sides(g)[1], ["k"], "left_anti").df.select("k", "n"))
_g("g_join_times", "SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM region a CROSS JOIN region b", lambda g: Rows(g, g.vertices["REGION"].select(F.col("id").cast("int").alias("x"))).join(Rows(g, g.vertices["REGION"].select(F.col("id").cast("int").alias("y"))), []).df)


def _sides(g: Graph) -> tuple[Rows, Rows]:
    """All customers and all suppliers."""
    c, s = g.vertices["CUSTOMER"], g.vertices["SUPPLIER"]
    return Rows(g, c.select(F.col("id").alias("k"), F.col("c_nationkey").alias("n"))), Rows(g, s.select(F.col("id").alias("k"), F.col("s_nationkey").alias("m")))


_g(
    "g_apply_count",
    "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    lambda g: Rows.scan(g, "c", ["CUSTOMER"]).apply(["c"], lambda r: r.expand("c", "o", ["PLACED"], props=["o_orderpriority"]).where(F.col("o__o_orderpriority") == "1-URGENT"), "inner", {"n": F.count(F.lit(1))}).df.select("c", "n"),
)
_g("g_group_multi", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first FROM orders GROUP BY ALL", lambda g: Rows.scan(g, "o", ["ORDERS"], ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"]).df.groupBy(F.col("o__o_orderstatus").alias("s"), F.col("o__o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o__o_totalprice"), 2).alias("total"), F.min("o__o_orderdate").alias("first")))
_g("g_topk_offset", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", lambda g: Rows.scan(g, "o", ["ORDERS"], ["o_totalprice"]).order([(F.col("o__o_totalprice"), False), (F.col("o"), True)], 5, 10).df.select("o", F.col("o__o_totalprice").alias("t")))
_g("g_order_nulls", "SELECT id, imdb_index AS x FROM person_name ORDER BY imdb_index ASC NULLS FIRST, id LIMIT 20", lambda g: Rows.scan(g, "a", ["NAME"], ["imdb_index"]).order([(F.col("a__imdb_index"), True), (F.col("a"), True)], 0, 20).df.select(F.col("a").alias("id"), F.col("a__imdb_index").alias("x")), film_graph)
_g("g_dedup_keys", "SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer", lambda g: Rows(g, g.vertices["CUSTOMER"].select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))).dedup(["n", "s"]).df)
_g("g_union", "SELECT n_nationkey::BIGINT AS a FROM nation UNION ALL SELECT n_nationkey::BIGINT FROM nation WHERE n_regionkey = 1", lambda g: Rows.scan(g, "a", ["NATION"]).union(Rows.scan(g, "a", ["NATION"]), ).df.select("a").limit(0).unionByName(Rows.scan(g, "a", ["NATION"]).df.select("a")).unionByName(Rows.scan(g, "a", ["NATION"], ["n_regionkey"]).where(F.col("a__n_regionkey") == 1).df.select("a")))
_g("g_unfold", "SELECT n_nationkey::BIGINT AS a, unnest([1, 2]) AS x FROM nation", lambda g: Rows.scan(g, "a", ["NATION"]).unfold(F.array(F.lit(1), F.lit(2)), "x").df.select("a", "x"))

# -- Cypher ------------------------------------------------------------------------------------------------------
_c(
    "cy_flagship",
    "MATCH (c:CUSTOMER)-[:PLACED]->(o:ORDERS)-[:CONTAINS]->(p:PART) WHERE p.p_brand = $b RETURN c.c_mktsegment AS seg, count(o) AS n ORDER BY n DESC, seg LIMIT 10",
    "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13' GROUP BY 1 ORDER BY n DESC, seg LIMIT 10",
    b="Brand#13",
)
_c(
    "cy_optional",
    "MATCH (c:CUSTOMER) OPTIONAL MATCH (c)-[r:PLACED]->(o:ORDERS) WHERE o.o_orderpriority = '1-URGENT' RETURN c.c_mktsegment AS seg, count(o) AS n, count(*) AS k",
    "SELECT c_mktsegment AS seg, count(o_orderkey) AS n, count(*) AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey GROUP BY 1",
)
_c(
    "cy_not_pattern",
    "MATCH (p:PART) WHERE p.p_size < 10 AND NOT (p)<-[:CONTAINS]-(:ORDERS {o_orderstatus: 'F'}) RETURN p.id AS id, p.p_brand AS brand",
    "SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_size < 10 AND NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'F')",
)
_c(
    "cy_with_having",
    "MATCH (s:SUPPLIER)-[r:SUPPLIES]->(p:PART) WITH s, count(p) AS parts, sum(r.n) AS lines WHERE parts > 400 MATCH (s)-[:IN_NATION]->(n:NATION) RETURN n.n_name AS nation, count(s) AS suppliers, sum(lines) AS lines",
    "SELECT n_name AS nation, count(*) AS suppliers, sum(lines)::BIGINT AS lines FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS lines FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE parts > 400 GROUP BY 1",
)
_c(
    "cy_two_patterns",
    "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION)<-[:IN_NATION]-(s:SUPPLIER), (n)-[:IN_REGION]->(r:REGION {r_name: 'ASIA'}) RETURN n.n_name AS nation, count(DISTINCT c) AS c, count(DISTINCT s) AS s",
    "SELECT n_name AS nation, count(DISTINCT c_custkey) AS c, count(DISTINCT s_suppkey) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
)
_c(
    "cy_unlabelled",
    "MATCH (a)-[:IN_NATION]->(n:NATION) WHERE n.n_name STARTS WITH 'NATION_1' RETURN labels(a) AS label, n.n_name AS nation, count(a) AS n",
    "SELECT 'CUSTOMER' AS label, n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' GROUP BY 2 UNION ALL SELECT 'SUPPLIER', n_name, count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' GROUP BY 2",
)
_c(
    "cy_case_extract",
    "MATCH (o:ORDERS) RETURN o.o_orderdate.year AS y, CASE WHEN o.o_totalprice > 250000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n",
    "SELECT year(o_orderdate)::INT AS y, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY ALL",
)
_c(
    "cy_string_predicates",
    "MATCH (p:PART) WHERE (p.p_name CONTAINS '1' AND p.p_type ENDS WITH 'S') OR p.p_brand =~ 'Brand#1[1-3]' RETURN p.id AS id",
    "SELECT p_partkey AS id FROM part WHERE (p_name LIKE '%1%' AND p_type LIKE '%S') OR regexp_full_match(p_brand, 'Brand#1[1-3]')",
)
_c(
    "cy_null_logic",
    "MATCH (t:TITLE) WHERE NOT t.production_year > 1990 RETURN t.id AS id, t.production_year AS y",
    "SELECT id, production_year AS y FROM title WHERE NOT coalesce(production_year > 1990, false)",
    film_graph,
)
_c(
    "cy_null_group",
    "MATCH (t:TITLE) RETURN t.production_year AS y, count(*) AS n, count(t.season_nr) AS s",
    "SELECT production_year AS y, count(*) AS n, count(season_nr) AS s FROM title GROUP BY 1",
    film_graph,
)
_c(
    "cy_unwind_in",
    "UNWIND [1, 2, 3, 4] AS r MATCH (n:NATION)-[:IN_REGION]->(x:REGION) WHERE x.id = r RETURN r AS r, count(n) AS n",
    "SELECT n_regionkey AS r, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2, 3, 4) GROUP BY 1",
)
_c(
    "cy_call_union",
    "MATCH (n:NATION)<-[:IN_NATION]-(s:SUPPLIER) RETURN n.n_name AS name, count(s) AS k UNION ALL MATCH (n:NATION)<-[:IN_NATION]-(c:CUSTOMER) RETURN n.n_name AS name, count(c) AS k",
    "SELECT n_name AS name, count(*) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)
_c(
    "cy_var_length",
    "MATCH (a:USER)-[:NEXT*1..3]->(b:USER) RETURN a.id AS a, count(DISTINCT b) AS reach, count(*) AS walks",
    f"{_P}, w AS (SELECT src, dst FROM h UNION ALL SELECT x.src, y.dst FROM h x JOIN h y ON x.dst = y.src) SELECT src AS a, count(DISTINCT dst) AS reach, count(*) AS walks FROM w GROUP BY 1",
    _user_graph,
)
_c(
    "cy_shortest",
    "MATCH p = shortestPath((a:USER)-[:NEXT*1..4]->(b:USER)) RETURN length(p) AS k, count(*) AS n",
    f"SELECT k, count(*) AS n FROM ({SQL['g_shortest_length']}) GROUP BY 1",
    _user_graph,
)
_c(
    "cy_collect_distinct",
    "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION) RETURN n.n_name AS nation, collect(DISTINCT c.c_mktsegment) AS segs, avg(c.c_acctbal) > 4500 AS rich",
    "SELECT n_name AS nation, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS segs, avg(c_acctbal) > 4500 AS rich FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
)
_c(
    "cy_bits_arith",
    "MATCH (p:PART) WHERE p.p_size % 7 = 3 RETURN p.id AS id, p.p_size / 4 AS q, p.p_size & 6 AS b, p.p_size ^ 5 AS x, p.p_size << 2 AS l, power(p.p_size, 2) AS s",
    "SELECT p_partkey AS id, (p_size // 4)::BIGINT AS q, p_size & 6 AS b, xor(p_size, 5) AS x, p_size << 2 AS l, pow(p_size, 2) AS s FROM part WHERE p_size % 7 = 3",
)
_c(
    "cy_duration",
    "MATCH (o:ORDERS)-[r:CONTAINS]->(p:PART) WHERE r.shipdate > o.o_orderdate + duration({days: 30}) AND r.quantity > 40 RETURN count(*) AS n",
    "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 30 DAY AND l_quantity > 40",
)
_c(
    "cy_costars",
    "MATCH (a:NAME)-[:CAST_INFO]->(t:TITLE)<-[:CAST_INFO]-(b:NAME) WHERE t.production_year = 1999 AND a <> b RETURN t.id AS t, count(DISTINCT a) AS actors",
    "WITH c AS (SELECT DISTINCT id, person_id, movie_id FROM cast_info JOIN (SELECT id AS p FROM person_name) ON p = person_id) SELECT movie_id::BIGINT AS t, count(DISTINCT a.person_id) AS actors FROM c a JOIN c b USING (movie_id) JOIN title t ON t.id = movie_id WHERE production_year = 1999 AND a.person_id <> b.person_id GROUP BY 1",
    film_graph,
)
_c(
    "cy_keywords",
    "MATCH (t:TITLE)-[:MOVIE_KEYWORD]->(k:KEYWORD) WHERE t.production_year > 2000 RETURN k.id AS k, count(t) AS n ORDER BY n DESC, k LIMIT 15",
    "SELECT keyword_id::BIGINT AS k, count(*) AS n FROM (SELECT DISTINCT id, movie_id, keyword_id FROM movie_keyword WHERE keyword_id IS NOT NULL) m JOIN title t ON t.id = m.movie_id WHERE production_year > 2000 GROUP BY 1 ORDER BY n DESC, k LIMIT 15",
    film_graph,
)
_c("cy_procedure", "CALL gs.procedure.meta.statistics() YIELD kind, label, n RETURN label AS label, sum(n) AS n", "SELECT * FROM (SELECT 'REGION' AS label, count(*)::BIGINT AS n FROM region UNION ALL SELECT 'NATION', count(*) FROM nation UNION ALL SELECT 'CUSTOMER', count(*) FROM customer UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier UNION ALL SELECT 'PART', count(*) FROM part UNION ALL SELECT 'ORDERS', count(*) FROM orders UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'FROM_SUPPLIER', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))")


# -- algorithms over the graph of users --------------------------------------------------------------------------
def _a(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, sql, lambda spark, d: f(_users(spark, d)))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to 6 places, so that the order of additions doesn't show."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _rounds(n: int, start: str, step: str, final: str, pre: str = _E) -> str:
    """SQL of a fixed number of rounds: `{p}` is the table before."""
    ctes = [f"s0 AS MATERIALIZED ({start})"] + [f"s{k} AS MATERIALIZED ({step.replace('{p}', f's{k - 1}')})" for k in range(1, n + 1)]
    return f"WITH {pre}, {', '.join(ctes)} {final.replace('{p}', f's{n}')}"


_a(
    "a_pagerank",
    _rounds(10, "SELECT id, 1 / n AS r FROM v, nv", "SELECT v.id, 0.85 * coalesce(m, 0) + 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM {p} ANTI JOIN dg USING (id)) / n AS r FROM v CROSS JOIN nv LEFT JOIN (SELECT dst AS id, sum(r / d) AS m FROM e JOIN {p} p ON p.id = e.src JOIN dg ON dg.id = e.src GROUP BY 1) USING (id)", "SELECT id, round(r, 6) AS rank FROM {p}"),
    lambda e: _r(al.pagerank(e, max_iter=10, tol=0.0), "rank"),
)
_a(
    "a_articlerank",
    _rounds(10, "SELECT id, 0.0::DOUBLE AS r FROM v", "SELECT v.id, 0.15 + 0.85 * coalesce(m, 0) AS r FROM v LEFT JOIN (SELECT dst AS id, sum(r / (d + (SELECT count(*) FROM e) / (SELECT n FROM nv))) AS m FROM e JOIN {p} p ON p.id = e.src JOIN dg ON dg.id = e.src GROUP BY 1) USING (id)", "SELECT id, round(r, 6) AS rank FROM {p}"),
    lambda e: _r(al.articlerank(e), "rank"),
)
_a(
    "a_ppr",
    _rounds(10, "SELECT id, CASE WHEN id = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM v", "SELECT v.id, 0.5 * CASE WHEN v.id = 1 THEN 1.0 ELSE 0.0 END + 0.5 * coalesce(m, 0) AS r FROM v LEFT JOIN (SELECT dst AS id, sum(r / d) AS m FROM u JOIN {p} p ON p.id = u.src JOIN ud ON ud.id = u.src GROUP BY 1) USING (id)", "SELECT id, round(r, 6) AS rank FROM {p}", _U),
    lambda e: _r(al.personalized_pagerank(e, 1), "rank"),
)
_a(
    "a_katz",
    _rounds(12, "SELECT id, 0.0::DOUBLE AS x FROM v", "SELECT v.id, 0.001 * coalesce(m, 0) + 1 AS x FROM v LEFT JOIN (SELECT dst AS id, sum(x * w) AS m FROM e JOIN {p} p ON p.id = e.src GROUP BY 1) USING (id)", "SELECT id, round(x / (SELECT sqrt(sum(x * x)) FROM {p}), 6) AS centrality FROM {p}"),
    lambda e: _r(al.katz_centrality(e, alpha=0.001), "centrality"),
)
_a("a_hits", None, lambda e: _r(al.hits(e), "hub", "auth"))
_a("a_eigenvector", None, lambda e: _r(al.eigenvector_centrality(e), "centrality"))
_a("a_degree", f"WITH {_E} SELECT id, round(count(*) / ((SELECT n FROM nv) - 1), 6) AS centrality FROM (SELECT unnest([src, dst]) AS id FROM e) GROUP BY 1", lambda e: _r(al.degree_centrality(e), "centrality"))
_a(
    "a_sssp",
    _rounds(14, "SELECT id, CASE WHEN id = 1 THEN 0.0 END::DOUBLE AS d FROM v", "SELECT p.id, least(p.d, m) AS d FROM {p} p LEFT JOIN (SELECT dst AS id, min(d + w) AS m FROM e JOIN {p} q ON q.id = e.src GROUP BY 1) USING (id)", "SELECT id, d AS distance FROM {p}"),
    lambda e: al.sssp(e, 1),
)
_a(
    "a_bfs",
    f"WITH RECURSIVE {_E}, b AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < 8), m AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1) SELECT m.id, m.depth, CASE WHEN m.id = 1 THEN 1 ELSE (SELECT min(e.src) FROM e JOIN m q ON q.id = e.src WHERE e.dst = m.id AND q.depth = m.depth - 1) END AS predecessor FROM m",
    lambda e: al.bfs(e, 1),
)
_a("a_wcc", f"WITH RECURSIVE {_U}, r AS (SELECT id AS a, id AS b FROM v UNION SELECT a, dst FROM r JOIN u ON u.src = r.b) SELECT a AS id, min(b) AS component FROM r GROUP BY 1", lambda e: al.wcc(e))
_a("a_scc", f"WITH RECURSIVE {_E}, r AS (SELECT id AS a, id AS b FROM v UNION SELECT a, dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1", lambda e: al.scc(e))
_a(
    "a_lpa",
    _rounds(10, "SELECT id, id AS l FROM v", "SELECT p.id, coalesce(k, p.l) AS l FROM {p} p LEFT JOIN (SELECT id, arg_min(l, (-n, l)) AS k FROM (SELECT dst AS id, l, count(*) AS n FROM u JOIN {p} q ON q.id = u.src GROUP BY ALL) GROUP BY 1) USING (id)", "SELECT id, l AS label FROM {p}", _U),
    lambda e: al.label_propagation(e),
)
_TRI = "t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND x.dst < y.dst), tv AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY 1)"
_a("a_triangles", f"WITH {_U}, {_TRI} SELECT v.id, coalesce(t, 0) AS triangles FROM v LEFT JOIN tv USING (id)", lambda e: al.triangles(e))
_a("a_clustering", f"WITH {_U}, {_TRI} SELECT v.id, round(CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) / 2) ELSE 0 END, 6) AS coefficient FROM v LEFT JOIN tv USING (id) LEFT JOIN ud USING (id)", lambda e: _r(al.clustering(e), "coefficient"))
_a("a_transitivity", f"WITH {_U}, {_TRI} SELECT round(6 * (SELECT count(*) FROM t) / (SELECT sum(d * (d - 1)) FROM ud), 6) AS value", lambda e: _r(al.transitivity(e), "value"))
_a("a_kclique4", f"WITH {_U}, {_TRI} SELECT count(*) AS n FROM t JOIN u x ON x.src = c AND x.dst > c JOIN u y ON y.src = a AND y.dst = x.dst JOIN u z ON z.src = b AND z.dst = x.dst", lambda e: al.k_clique_count(e, 4))
_a("a_3path", f"WITH {_U}, {_TRI} SELECT (SELECT sum((p.d - 1) * (q.d - 1)) FROM u JOIN ud p ON p.id = src JOIN ud q ON q.id = dst WHERE src < dst)::BIGINT - 3 * (SELECT count(*) FROM t) AS n", lambda e: al.three_path_count(e))
_a("a_tailed_triangle", f"WITH {_U}, {_TRI} SELECT sum(t * (d - 2))::BIGINT AS n FROM tv JOIN ud USING (id)", lambda e: al.tailed_triangle_count(e))
_CO = "co AS MATERIALIZED (SELECT x.dst AS a, y.dst AS b, count(*) AS k FROM u x JOIN u y ON x.src = y.src WHERE x.dst < y.dst GROUP BY ALL)"
_a("a_rectangle", f"WITH {_U}, {_CO} SELECT (sum(k * (k - 1) // 2) // 2)::BIGINT AS n FROM co", lambda e: al.rectangle_count(e))
_a("a_diamond", f"WITH {_U}, {_CO} SELECT sum(k * (k - 1) // 2)::BIGINT AS n FROM co JOIN u ON u.src = a AND u.dst = b", lambda e: al.diamond_count(e))
_a("a_cyclic_triangle", f"WITH {_E} SELECT (count(*) // 3)::BIGINT AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src <> y.dst", lambda e: al.directed_triangle_count(e, "cyclic"))
_a("a_acyclic_triangle", f"WITH {_E} SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE x.src <> y.dst", lambda e: al.directed_triangle_count(e, "acyclic"))
_a("a_deg_assort", f"WITH {_E}, di AS (SELECT dst AS id, count(*) AS d FROM e GROUP BY 1) SELECT round(corr(coalesce(dg.d, 0), coalesce(di.d, 0)), 6) AS value FROM e LEFT JOIN dg ON dg.id = src LEFT JOIN di ON di.id = dst", lambda e: _r(al.degree_assortativity(e), "value"))
_a("a_avg_deg_conn", f"WITH {_E}, b AS (SELECT id, count(*) AS d FROM (SELECT unnest([src, dst]) AS id FROM e) GROUP BY 1) SELECT x.d AS degree, round(avg(y.d), 6) AS connectivity FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) JOIN b x ON x.id = src JOIN b y ON y.id = dst GROUP BY 1", lambda e: _r(al.average_degree_connectivity(e), "connectivity"))
_a("a_attr_assort", f"WITH {_E}, c AS (SELECT src % 3 AS x, dst % 3 AS y, count(*)::DOUBLE AS n FROM e GROUP BY ALL), s AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE x = y) AS t FROM c), ab AS (SELECT sum(a * b) AS ab FROM (SELECT x, sum(n) AS a FROM c GROUP BY 1) JOIN (SELECT y AS x, sum(n) AS b FROM c GROUP BY 1) USING (x)) SELECT round((t / n - ab / (n * n)) / (1 - ab / (n * n)), 6) AS value FROM s, ab", lambda e: _r(al.attribute_assortativity(e, al.ends(e).select("id", (F.col("id") % 3).alias("a"))), "value"))
_a("a_node_boundary", f"WITH {_E} SELECT DISTINCT dst AS id FROM e WHERE src % 50 = 1 AND dst % 50 <> 1", lambda e: al.node_boundary(e, al.ends(e).where("id % 50 = 1")))
_a("a_edge_boundary", f"WITH {_E} SELECT DISTINCT src, dst FROM e WHERE src % 50 = 1 AND dst % 50 <> 1", lambda e: al.edge_boundary(e, al.ends(e).where("id % 50 = 1")).select("src", "dst"))
_a(
    "a_core_numbers",
    _rounds(25, "SELECT v.id, coalesce(d, 0) AS c FROM v LEFT JOIN ud USING (id)", "SELECT p.id, least(p.c, coalesce(h, 0)) AS c FROM {p} p LEFT JOIN (SELECT id, max(least(r, c)) AS h FROM (SELECT dst AS id, c, row_number() OVER (PARTITION BY dst ORDER BY c DESC) AS r FROM u JOIN {p} q ON q.id = u.src) GROUP BY 1) USING (id)", "SELECT id, c::INT AS core FROM {p}", _U),
    lambda e: al.core_numbers(e),
)
_a("a_k_core", f"SELECT id FROM ({SQL['a_core_numbers']}) WHERE core >= 20", lambda e: al.k_core(e, 20))
_a("a_k_shell", f"SELECT id FROM ({SQL['a_core_numbers']}) WHERE core = (SELECT min(core) FROM ({SQL['a_core_numbers']}))", lambda e: al.k_shell(e))
_a("a_louvain", None, lambda e: al.louvain(e))
_a("a_coloring", None, lambda e: al.graph_coloring(e))
_a("a_mis", None, lambda e: al.maximal_independent_set(e))
_a("a_matching", None, lambda e: al.maximal_matching(e))
_a(
    "a_msf",
    f"""WITH RECURSIVE {_U}, ws AS (SELECT DISTINCT w FROM u), r AS (SELECT ws.w AS t, id AS a, id AS b FROM ws, v UNION SELECT r.t, r.a, u.dst FROM r JOIN u ON u.src = r.b AND u.w <= r.t),
    c AS (SELECT t, count(DISTINCT m) AS c FROM (SELECT t, a, min(b) AS m FROM r GROUP BY ALL) GROUP BY 1), k AS (SELECT t, c, lag(c, 1, (SELECT count(*) FROM v)) OVER (ORDER BY t) - c AS k FROM c)
    SELECT sum(k)::BIGINT AS n, sum(k * t) AS weight, min(c) AS trees FROM k""",
    lambda e: _forest(e),
)


def _forest(e: DataFrame) -> DataFrame:
    """Edges, weight and trees of the minimum spanning forest; it has no cycle if these make up the vertices."""
    f = al.materialize(al.minimum_spanning_forest(e))
    trees = al.wcc(f, al.ends(e)).agg(F.count_distinct("component").alias("t"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight")).select("n", "weight", trees.scalar().alias("trees"))


def _independent(e: DataFrame) -> DataFrame:
    """Edges within the set, and vertices outside that have no neighbour in it."""
    m = al.materialize(al.maximal_independent_set(e))
    u = al.both(e).select("src", "dst")
    near = u.join(m.withColumnRenamed("id", "src"), "src", "left_semi")
    inner = near.join(m.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    free = al.ends(e).join(m, "id", "left_anti").join(near.select(F.col("dst").alias("id")), "id", "left_anti")
    return free.agg(F.count(F.lit(1)).alias("addable")).select(inner.scalar().alias("inner_edges"), "addable")


def _matched(e: DataFrame) -> DataFrame:
    """Vertices met twice by the matching, and edges that could join it."""
    at = al.materialize(al.maximal_matching(e).select(F.explode(F.array("src", "dst")).alias("id")))
    free = al.both(e).join(at.withColumnRenamed("id", "src"), "src", "left_anti").join(at.withColumnRenamed("id", "dst"), "dst", "left_anti")
    twice = at.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("k"))
    return free.agg(F.count(F.lit(1)).alias("addable")).select(twice.scalar().alias("met_twice"), "addable")


_a("a_mis_valid", "SELECT 0::BIGINT AS inner_edges, 0::BIGINT AS addable", _independent)
_a("a_matching_valid", "SELECT 0::BIGINT AS met_twice, 0::BIGINT AS addable", _matched)
_DIST = f"WITH RECURSIVE {_U}, r AS (SELECT id AS a, id AS b, 0 AS k FROM v UNION SELECT a, dst, k + 1 FROM r JOIN {{g}} ON src = r.b WHERE k < 6), d AS (SELECT a, b, min(k) AS k FROM r GROUP BY ALL)"
_a("a_all_pairs", _DIST.replace("{g}", "e") + " SELECT a AS source, b AS id, k::DOUBLE AS dist FROM d", lambda e: al.all_pairs_shortest_path_length(e, weighted=False))
_a("a_average_path", _DIST.replace("{g}", "e") + " SELECT round(sum(k) / (SELECT n * (n - 1) FROM nv), 6) AS value FROM d", lambda e: _r(al.average_shortest_path_length(e), "value"))
_a("a_harmonic", _DIST.replace("{g}", "u") + " SELECT b AS id, round(sum(CASE WHEN k > 0 THEN 1 / k ELSE 0 END), 6) AS centrality FROM d GROUP BY 1", lambda e: _r(al.harmonic_centrality(e), "centrality"))
_a("a_bfs_undirected", _DIST.replace("{g}", "u") + " SELECT b AS id, k AS depth FROM d WHERE a = 1", lambda e: al.bfs(e, 1, undirected=True).select("id", "depth"))
_a("a_sssp_path", _rounds(14, "SELECT id, CASE WHEN id = 1 THEN 0.0 END::DOUBLE AS d FROM v", "SELECT p.id, least(p.d, m) AS d FROM {p} p LEFT JOIN (SELECT dst AS id, min(d + w) AS m FROM e JOIN {p} q ON q.id = e.src GROUP BY 1) USING (id)", "SELECT min(e.src) AS src, e.dst, any_value(y.d) AS distance FROM e JOIN {p} x ON x.id = e.src JOIN {p} y ON y.id = e.dst WHERE x.d + e.w = y.d AND e.dst <> 1 GROUP BY e.dst"), lambda e: al.sssp_path(e, 1))
for _kind, _sql in (("cycle_plus", "e z ON z.src = y.dst AND z.dst = x.src JOIN e b ON b.src = x.dst AND b.dst = x.src"), ("in_plus", "e z ON z.src = x.src AND z.dst = y.dst JOIN e b ON b.src = x.dst AND b.dst = x.src AND x.src < x.dst")):
    _a(f"a_{_kind}_triangle", f"WITH {_E} SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN {_sql} WHERE y.dst <> x.src", lambda e, k=_kind: al.directed_triangle_count(e, k))
_a("a_out_plus_triangle", f"WITH {_E} SELECT count(*) AS n FROM e x JOIN e b ON b.src = x.dst AND b.dst = x.src AND x.src < x.dst JOIN e y ON y.dst = x.src JOIN e z ON z.src = y.src AND z.dst = x.dst", lambda e: al.directed_triangle_count(e, "out_plus"))
_a("a_clustering_directed", f"WITH {_E}, b AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY ALL), t AS (SELECT x.src AS id, sum(x.m * y.m * z.m) AS t FROM b x JOIN b y ON y.src = x.src JOIN b z ON z.src = x.dst AND z.dst = y.dst WHERE x.dst < y.dst GROUP BY 1), g AS (SELECT src AS id, sum(m) AS dt, count(*) FILTER (WHERE m = 2) AS dr FROM b GROUP BY 1) SELECT id, round(CASE WHEN dt * (dt - 1) > 2 * dr THEN coalesce(t, 0) / (dt * (dt - 1) - 2 * dr) ELSE 0 END, 6)::DOUBLE AS coefficient FROM g LEFT JOIN t USING (id)", lambda e: _r(al.clustering(e, directed=True), "coefficient"))
_a("a_katz_flash", _rounds(10, "SELECT id, 1.0::DOUBLE AS x FROM v", "SELECT v.id, 0.01 * coalesce(m, 0) AS x FROM v LEFT JOIN (SELECT src AS id, sum(x + 1) AS m FROM e JOIN {p} p ON p.id = e.dst GROUP BY 1) USING (id)", "SELECT id, round(x, 6) AS centrality FROM {p}"), lambda e: _r(al.katz_flash(e, alpha=0.01), "centrality"))
_a("a_eigenvector_flash", _rounds(10, "SELECT id, 1.0 / n AS x FROM v, nv", "SELECT id, y / sqrt(sum(y) OVER ()) AS x FROM (SELECT v.id, coalesce(m, 0) AS y FROM v LEFT JOIN (SELECT dst AS id, sum(x) AS m FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) JOIN {p} p ON p.id = src GROUP BY 1) USING (id))", "SELECT id, round(x, 4) AS centrality FROM {p}"), lambda e: al.eigenvector_flash(e).withColumn("centrality", F.round("centrality", 4)))
_a("a_pagerank_fixed", _rounds(10, "SELECT id, 1 / n AS r FROM v, nv", "SELECT p.id, 0.15 / n + 0.85 * coalesce(m, 0) + CASE WHEN d IS NULL THEN 0.85 * p.r ELSE 0 END AS r FROM {p} p CROSS JOIN nv LEFT JOIN dg USING (id) LEFT JOIN (SELECT dst AS id, sum(r / d) AS m FROM e JOIN {p} q ON q.id = e.src JOIN dg ON dg.id = e.src GROUP BY 1) USING (id)", "SELECT id, round(r, 6) AS rank FROM {p}"), lambda e: _r(al.pagerank_fixed(e), "rank"))
_a("a_num_assort", f"WITH {_E} SELECT round(corr(src, dst), 6) AS value FROM e", lambda e: _r(al.numeric_assortativity(e, al.ends(e).select("id", F.col("id").alias("a"))), "value"))
_a("a_weighted_assort", f"WITH {_E}, o AS (SELECT src AS id, sum(w) AS d FROM e GROUP BY 1), i AS (SELECT dst AS id, sum(w) AS d FROM e GROUP BY 1) SELECT round(corr(coalesce(o.d, 0), coalesce(i.d, 0)), 6) AS value FROM e LEFT JOIN o ON o.id = src LEFT JOIN i ON i.id = dst", lambda e: _r(al.degree_assortativity(e, weighted=True), "value"))
_a("a_closeness", _DIST.replace("{g}", "e") + " SELECT b AS id, round(CASE WHEN sum(k) > 0 THEN (count(*) - 1) / sum(k) * (count(*) - 1) / (SELECT n - 1 FROM nv) ELSE 0 END, 6) AS centrality FROM d GROUP BY 1", lambda e: _r(al.closeness_centrality(e), "centrality"))

# -- graphs, selectors, sampling ---------------------------------------------------------------------------------
_g("s_project", "SELECT c_custkey AS id, c_mktsegment FROM customer", lambda g: g.project({"CUSTOMER": ["c_mktsegment"], "ORDERS": []}, {"PLACED": None}).vertices["CUSTOMER"])
_g("s_induce", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'", lambda g: g.induce("CUSTOMER", g.vertices["CUSTOMER"].where("c_mktsegment = 'BUILDING'").select("id")).edges["CUSTOMER", "PLACED", "ORDERS"].select("src", "dst"))
_g("s_undirected", f"WITH {_E}, h AS (SELECT src, dst, w FROM e) SELECT src, dst, w FROM h UNION SELECT dst, src, w FROM h", lambda g: g.to_undirected().edges["USER", "NEXT", "USER"], _user_graph)
_g("s_add_column", "SELECT c_custkey AS id, c_mktsegment AS seg, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey", lambda g: g.add_column("CUSTOMER", g.edges["CUSTOMER", "PLACED", "ORDERS"].groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), {"n": "k"}).vertices["CUSTOMER"].select("id", F.col("c_mktsegment").alias("seg"), "n"))
_g("s_consolidate", "SELECT p_partkey AS id, [p_brand, p_type] AS kinds FROM part", lambda g: g.consolidate("PART", ["p_brand", "p_type"], "kinds").vertices["PART"].select("id", "kinds"))
_g("s_selectors", "SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey::VARCHAR >= '10' AND c_custkey::VARCHAR < '12'", lambda g: select(g, {"k": "v.id", "seg": "v.c_mktsegment"}, "CUSTOMER", vertex_range=("10", "12")))
QUERIES = dict(QUERIES)
