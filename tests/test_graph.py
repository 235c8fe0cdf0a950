import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph, select
from loomgraph.operators import algorithms as al
from loomgraph.operators import flash, sampling
from loomgraph.plans.cypher import cypher
from loomgraph.plans.gremlin import gremlin, subgraph
from loomgraph.plans.rows import Rows
from loomgraph.sources import load_from
from loomgraph.streaming import VersionedTable, merge, upsert_stream

from .conftest import rows


@pytest.fixture(scope="module")
def modern(spark):
    person = spark.createDataFrame([(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)], "id long, name string, age int")
    software = spark.createDataFrame([(3, "lop", "java"), (5, "ripple", "java")], "id long, name string, lang string")
    knows = spark.createDataFrame([(1, 2, 0.5), (1, 4, 1.0)], "src long, dst long, weight double")
    created = spark.createDataFrame([(1, 3, 0.4), (4, 3, 0.4), (4, 5, 1.0), (6, 3, 0.2)], "src long, dst long, weight double")
    return Graph({"person": person, "software": software}, {("person", "knows", "person"): knows, ("person", "created", "software"): created})


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")


def test_cypher_on_modern(modern):
    q = lambda text, **p: rows(cypher(modern, text, **p))
    assert q("MATCH (a:person {name: 'marko'})-[:knows]->(b) RETURN b.name AS n") == [("josh",), ("vadas",)]
    assert q("MATCH (a)-[r]->(b) WHERE r.weight >= 1.0 RETURN a.name AS a, type(r) AS t, b.name AS b") == [("josh", "created", "ripple"), ("marko", "knows", "josh")]
    assert q("MATCH (a:person) OPTIONAL MATCH (a)-[:created]->(s) RETURN a.name AS a, count(s) AS n") == [("josh", 2), ("marko", 1), ("peter", 1), ("vadas", 0)]
    assert q("MATCH (a:person) WHERE NOT (a)-[:created]->() RETURN a.name AS a") == [("vadas",)]
    assert q("MATCH (a:person)-[:knows*1..2]->(b) RETURN count(*) AS n") == [(2,)]
    assert q("MATCH p = (a:person)-[:knows*1..3]->(b) RETURN length(p) AS k") == [(1,), (1,)]
    assert q("MATCH p = shortestPath((a:person {name: 'marko'})-[*1..5]-(b:person {name: 'peter'})) RETURN length(p) AS k") == [(2,)]
    assert q("MATCH (a:person)-[:created]->(s)<-[:created]-(b:person) WHERE a <> b RETURN a.name AS a, b.name AS b, s.name AS s ORDER BY a, b LIMIT 2") == [("josh", "marko", "lop"), ("josh", "peter", "lop")]
    assert q("MATCH (a:person) WITH a ORDER BY a.age DESC LIMIT 2 RETURN a.name AS n") == [("josh",), ("peter",)]
    assert q("MATCH (a:person) WHERE a.age IN [27, 29] OR a.name STARTS WITH 'p' RETURN sum(a.age) AS s, $x AS x", x=7) == [(91, 7)]
    assert q("UNWIND [1, 2] AS x RETURN x AS x, x / 2 AS h") == [(1, 0), (2, 1)]
    assert q("MATCH (a:person) RETURN DISTINCT a.age > 30 AS old, gs.function.concat(a.name, a.name) AS c ORDER BY c LIMIT 1") == [(True, "josh;josh")]
    assert q("CALL k_hop_neighbors('person', 1, 1) YIELD label, id RETURN label AS l, count(*) AS n") == [("person", 2), ("software", 1)]
    with pytest.raises(ValueError):
        q("MATCH (a:software)-[:knows]->(b) RETURN b")


def test_gremlin_on_modern(modern):
    q = lambda text: rows(gremlin(modern, text))
    assert q("g.V().hasLabel('person').has('age', gt(30)).values('name')") == [("josh",), ("peter",)]
    assert q("g.V(1).outE('knows').has('weight', gte(1.0)).inV().values('name')") == [("josh",)]
    assert q("g.V().hasLabel('person').as('a').out('created').in('created').hasLabel('person').as('b').where('a', neq('b')).select('a', 'b').by('name').by('name')")[0] == ("josh", "marko")
    assert q("g.V().hasLabel('person').where(__.not(out('created'))).values('name')") == [("vadas",)]
    assert q("g.V().hasLabel('person').as('p').select('p').by(out('created').count())") == [(0,), (1,), (1,), (2,)]
    g = subgraph(modern, "g.E().hasLabel('knows').subgraph('x')")
    assert g.vertices["person"].count() == 3 and g.edges["person", "knows", "person"].count() == 2


def test_operators_on_empty_graph(modern):
    g = modern.clear_edges()
    assert Rows.scan(g, "a", ["person"]).expand("a", "b", ["knows"]).df.count() == 0
    assert Rows.scan(g, "a", ["person"]).degree("a", "n").df.agg(F.sum("n")).first()[0] == 0
    for f in (al.pagerank, al.wcc, al.triangles, al.label_propagation, al.core_numbers, al.maximal_independent_set):
        assert f(g.simple()).count() == 0


def test_path_options(spark):
    g = Graph.from_edges({("V", "e", "V"): spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")})
    n = lambda **k: Rows.scan(g, "a").path_expand("a", "b", 3, 4, ["e"], **k).df.count()
    assert n() == 3 and n(option="trail") == 1 and n(option="simple") == 0
    assert rows(Rows.scan(g, "a").path_expand("a", "b", 0, 1, ["e"]).df.select("a", "b")) == [(1, 1), (2, 2), (3, 3)]


def test_closed_form_algorithms(spark):
    k4 = edges(spark, [(a, b) for a in range(1, 5) for b in range(a + 1, 5)])
    assert al.k_clique_count(k4, 3).first().n == 4 and al.rectangle_count(k4).first().n == 3 and al.diamond_count(k4).first().n == 6
    assert al.transitivity(k4).first().value == 1.0 and {r.core for r in al.core_numbers(k4).collect()} == {3}
    p5 = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    assert rows(al.bfs(p5, 1).select("id", "depth")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    b = {r.id: r.centrality for r in al.betweenness_centrality(p5, normalized=False, directed=False).collect()}
    assert b == {1: 0.0, 2: 3.0, 3: 4.0, 4: 3.0, 5: 0.0}
    assert al.is_simple_path(p5, [1, 2, 3]) and not al.is_simple_path(p5, [1, 3]) and al.has_path(p5, 1, 5)
    cycle = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert rows(al.scc(cycle)) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert abs(al.pagerank(cycle).agg(F.sum("rank")).first()[0] - 1) < 1e-6
    assert al.directed_triangle_count(cycle, "cyclic").first().n == 1


def test_biconnectivity(spark):
    two = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)])
    assert rows(flash.bridges(two)) == [(3, 4)]
    assert rows(flash.cut_points(two)) == [(3,), (4,)]


def test_sets_and_matchings_are_valid(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5)])
    pairs = {frozenset((r.src, r.dst)) for r in e.collect()}
    mis = {r.id for r in al.maximal_independent_set(e).collect()}
    assert not any(p <= mis for p in pairs) and all(v in mis or any(v in p and p & mis for p in pairs) for v in range(1, 6))
    m = [r.id for r in al.maximal_matching(e).select(F.explode(F.array("src", "dst")).alias("id")).collect()]
    assert len(m) == len(set(m)) and all(p & set(m) for p in pairs)
    c = {r.id: r.color for r in al.graph_coloring(e).collect()}
    assert all(len({c[v] for v in p}) == 2 for p in pairs)


def test_pregel_counts_degrees(spark):
    e = edges(spark, [(1, 2), (3, 2), (2, 1)])
    state = al.ends(e).withColumn("n", F.lit(0).cast("long"))
    out = al.pregel(e, state, {"m": F.lit(1)}, {"m": F.sum}, {"n": F.coalesce("m", F.lit(0))}, 1)
    assert rows(out) == [(1, 1), (2, 2), (3, 0)]


def test_sessions(modern, spark, tmp_path):
    r = spark.createDataFrame([(1, 0.5)], "id long, x double")
    g = modern.add_column("person", r, {"score": "x"}).consolidate("person", ["name"], "names")
    assert rows(g.vertices["person"].where("id = 1").select("score", "names")) == [(0.5, ["marko"])]
    assert rows(select(modern, {"i": "v.id", "l": "v.label_id", "x": "r.x"}, "person", r, ("1", "2"))) == [(1, 0, 0.5)]
    assert modern.induce("person", modern.vertices["person"].where("id <> 4").select("id")).edges["person", "knows", "person"].count() == 1
    modern.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert rows(back.statistics()) == rows(modern.statistics())
    assert load_from({("a", "e", "b"): spark.createDataFrame([(1, 2)], "x long, y long")}, generate_eid=True).edges["a", "e", "b"].columns == ["src", "dst", "eid"]
    assert sampling.neighbors(modern.simple("weight"), spark.createDataFrame([(4,)], "id long"), 1, "topk").first().dst == 5


def test_change_feed(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, x string, y int")
    ch = [(1, None, 9, "UPDATE", 1), (2, None, None, "DELETE", 2), (4, "d", None, "INSERT", 3), (3, "z", None, "CLEAR_PROPERTY", 4), (5, None, None, "DELETE", 5)]
    changes = spark.createDataFrame(ch, "id long, x string, y int, op string, seq int")
    assert rows(merge(base, changes, ["id"], ["seq"])) == sorted([(1, "a", 9), (3, None, 3), (4, "d", None)], key=repr)
    feed = tmp_path / "feed"
    changes.withColumn("op", F.lit("INSERT")).write.parquet(str(feed))
    table = VersionedTable(spark, str(tmp_path / "t"), "id long, x string, y int")
    upsert_stream(spark.readStream.schema(changes.schema).parquet(str(feed)), table, ["id"], ["seq"], str(tmp_path / "c")).awaitTermination()
    assert table.versions() == [0] and table.read().count() == 5


def test_changes_of_one_key_apply_in_order_however_they_are_batched(spark):
    base = spark.createDataFrame([(1, "a", 1)], "id long, x string, y int")
    ch = [(1, "q", None, "UPDATE"), (1, None, 7, "UPDATE"), (2, "b", 2, "INSERT"), (2, None, 3, "UPDATE"), (3, "c", 3, "INSERT"), (3, None, None, "DELETE"), (3, None, 5, "UPDATE"), (1, "any", None, "CLEAR_PROPERTY"), (4, "z", None, "CLEAR_PROPERTY")]
    schema = "id long, x string, y int, op string, seq int"
    changes = [(*c, k) for k, c in enumerate(ch)]
    whole = rows(merge(base, spark.createDataFrame(changes, schema), ["id"], ["seq"]))
    assert whole == sorted([(1, None, 7), (2, "b", 3), (3, None, 5)], key=repr)
    for cut in (2, 4, 6):
        first = merge(base, spark.createDataFrame(changes[:cut], schema), ["id"], ["seq"])
        assert rows(merge(first, spark.createDataFrame(changes[cut:], schema), ["id"], ["seq"])) == whole


def test_parallel_edges(spark):
    g = Graph.from_edges({("V", "e", "V"): spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "src long, dst long")})
    assert Rows.scan(g, "a").path_expand("a", "b", 3, 4, ["e"], option="trail").df.count() == 2
    e = spark.createDataFrame([(1, 2, 0.1), (1, 2, 5.0), (1, 2, 5.0)], "src long, dst long, weight double")
    sub = subgraph(Graph.from_edges({("V", "e", "V"): e}), "g.E().has('weight', gt(1.0)).subgraph('x')")
    assert rows(sub.edges["V", "e", "V"]) == [(1, 2, 5.0), (1, 2, 5.0)] and sub.vertices["V"].count() == 2


def test_paths_with_edges_optional_ends_and_concatenation(modern):
    r = Rows.scan(modern, "a", ["person"], ["name"]).path_expand("a", "b", 1, 2, ["created"], path="p", path_edges=["weight"], optional=True)
    got = {x.n: x.es for x in r.df.where("a <> 4").select(F.col("a__name").alias("n"), F.col("p__edges").alias("es")).collect()}
    assert got["vadas"] is None and [(e.label, e.src, e.dst, e.weight) for e in got["peter"]] == [("created", 6, 3, 0.2)]
    assert rows(cypher(modern, "MATCH p = (a:person)-[:knows*1..2]->(b) RETURN b.name AS n, relationships(p) AS r"))[0][1][0].weight == 1.0
    assert [len(p[0]) for p in rows(gremlin(modern, "g.V(1).out('1..3', 'knows', 'created').with('RESULT_OPT', 'ALL_V_E')"))] .count(3) == 3
    two = Rows.scan(modern, "a", ["person"]).path_expand("a", "b", 1, 2, ["knows"], path="p").path_expand("b", "c", 1, 2, ["created"], path="q").concat_paths("p", "q", "r")
    assert sorted([v.id for v in x.r] for x in two.df.select("r").collect()) == [[1, 4, 3], [1, 4, 5]]


def test_shortest_paths_of_any_length(spark):
    g = Graph.from_edges({("V", "e", "V"): spark.createDataFrame([(i, i + 1) for i in range(1, 41)] + [(1, 50), (50, 3)], "src long, dst long")})
    one = Rows.scan(g, "a").where(F.col("a") == 1)
    d = {r.b: r.k for r in one.shortest("a", "b", None, ["e"], path="p").df.select("b", (F.size("p") - 1).alias("k")).collect()}
    assert d[41] == 40 and d[3] == 2 and len(d) == 41
    ends = rows(one.shortest("a", "b", None, ["e"], path="p", every=True, limit=4).df.select("b", F.size("p").alias("k")))
    assert ends == [(2, 2), (3, 3), (3, 3), (50, 2)]
    assert rows(cypher(g, "MATCH p = shortestPath((a:V {id: 2})-[*]->(b:V {id: 30})) RETURN length(p) AS k")) == [(28,)]


def test_labels_with_the_same_ids(spark):
    e = spark.createDataFrame([(1, 1), (2, 2)], "src long, dst long")
    g = Graph.from_edges({("A", "to", "B"): e, ("B", "to", "C"): e.where("src = 1")})
    assert {(r.label, r.id): (r.component.label, r.component.id) for r in g.run(al.wcc).collect()} == {("A", 1): ("A", 1), ("B", 1): ("A", 1), ("C", 1): ("A", 1), ("A", 2): ("A", 2), ("B", 2): ("A", 2)}
    assert {(r.label, r.id, r.distance) for r in g.run(al.sssp, ("A", 1)).collect()} == {("A", 1, 0.0), ("B", 1, 1.0), ("C", 1, 2.0), ("A", 2, None), ("B", 2, None)}
    assert g.run(al.pagerank).count() == 5 and {r.depth for r in g.run(al.bfs, ("A", 1)).collect()} == {0, 1, 2}


def test_negatives_have_their_count(spark):
    e = spark.createDataFrame([(s, d) for s in range(20) for d in range(20) if (s * d) % 3 and s != d], "src long, dst long")
    ids = spark.range(20).select("id")
    edge = {(r.src, r.dst) for r in e.collect()}
    got = sampling.negatives(e, ids, 8).collect()
    assert len({(r.src, r.dst) for r in got}) == len(got) and not edge & {(r.src, r.dst) for r in got} and all(r.src != r.dst for r in got)
    for s in {a for a, _ in edge}:
        assert sum(r.src == s for r in got) == min(8, 19 - sum(a == s for a, _ in edge)), s


def test_directed_counts(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (1, 3), (3, 4)])
    n = lambda kind: al.directed_triangle_count(e, kind).first().n
    have = {(1, 2), (2, 1), (2, 3), (3, 1), (1, 3), (3, 4)}
    ids = [1, 2, 3, 4]
    two = lambda x, y: (x, y) in have and (y, x) in have
    triples = [(x, y, z) for x in ids for y in ids for z in ids if len({x, y, z}) == 3]
    assert n("cyclic") == sum((x, y) in have and (y, z) in have and (z, x) in have for x, y, z in triples) / 3
    assert n("acyclic") == sum((x, y) in have and (y, z) in have and (x, z) in have for x, y, z in triples)
    assert n("cycle_plus") == sum(two(x, y) and (y, z) in have and (z, x) in have for x, y, z in triples)
    assert n("in_plus") == sum(two(x, y) and (x, z) in have and (y, z) in have for x, y, z in triples if x < y)
    assert n("out_plus") == sum(two(x, y) and (z, x) in have and (z, y) in have for x, y, z in triples if x < y)
    c = {r.id: r.coefficient for r in al.clustering(e, directed=True).collect()}
    m = lambda x, y: ((x, y) in have) + ((y, x) in have)
    for v in ids:
        t = sum(m(v, y) * m(v, z) * m(y, z) for y in ids for z in ids if len({v, y, z}) == 3 and y < z)
        dt, dr = sum(m(v, y) for y in ids if y != v), sum(two(v, y) for y in ids if y != v)
        assert abs(c[v] - (t / (dt * (dt - 1) - 2 * dr) if t else 0)) < 1e-9


def test_further_algorithms(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])
    assert rows(al.sssp_path(e, 1)) == [(1, 2, 1.0), (1, 3, 1.0), (3, 4, 2.0)]
    assert rows(al.random_multi_bfs(e, sources=spark.createDataFrame([(1,), (2,)], "id long"))) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    k = {r.id: r.centrality for r in al.katz_flash(e).collect()}
    assert k[4] == 0.0 and abs(k[3] - 0.1) < 1e-9 and abs(k[2] - 0.11) < 1e-9
    ring = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)])
    assert {r.label for r in al.fluid_communities(ring, 2).collect()} <= {0, 1}
    assert abs(al.eigenvector_flash(ring).agg(F.sum("centrality")).first()[0]) > 0
    x, y = Rows.scan(Graph({"V": al.ends(ring)}), "a"), Rows.scan(Graph({"V": al.ends(e)}), "b")
    assert rows(x.zip(y, [F.col("a")], [F.col("b")]).df.select("a", "b")) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert {k: r.df.count() for k, r in x.switch(low=F.col("a") < 3).items()} == {"low": 2, "default": 4}
    assert x.merge_tagged(other=x).df.groupBy("tag").count().count() == 2


def test_searches_of_many_rounds(spark):
    chain = edges(spark, [(i, i + 1) for i in range(1, 20)])
    assert rows(al.bfs(chain, 1).select("id", "depth")) == sorted(((i, i - 1) for i in range(1, 21)), key=repr)
    assert rows(al.sssp(chain, 1)) == sorted(((i, float(i - 1)) for i in range(1, 21)), key=repr)
