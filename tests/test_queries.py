"""Registered queries against brute force on small tables."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from loomgraph.queries import graph, gremlin, more

from .conftest import rows

USERS = [1, 2, 3, 1, 4, 5, 6, 4, 2, 7, 12, 3, 8, 1]  # no transition occurs twice
CUSTOMERS, SUPPLIERS = [1, 15, 30, 60, 90, 91], [2, 15, 30, 80, 91]
PAIRS = sorted(set(zip(USERS, USERS[1:])))
QUERIES = graph.QUERIES | gremlin.QUERIES | more.QUERIES


@pytest.fixture(scope="module")
def d(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    events = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), u, "click", 1.0) for i, u in enumerate(USERS)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    for table, schema, data in (
        ("region", "r_regionkey int, r_name string", [(0, "A")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "a", 0), (1, "b", 0)]),
        ("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(i, "", i % 2, 0.0, "") for i in CUSTOMERS]),
        ("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, "", i % 2, 0.0) for i in SUPPLIERS]),
        ("part", "p_partkey long", []),
        ("orders", "o_orderkey long, o_custkey long, o_orderdate date", []),
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date", []),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{table}.parquet")
    return str(at)


def walks(k):
    out = [(a,) for a in set(USERS)]
    for _ in range(k):
        out = [(*w, b) for w in out for a, b in PAIRS if a == w[-1]]
    return out


def distances():
    """Length and number of the shortest paths by pair, up to three steps."""
    out = {}
    for k in (1, 2, 3):
        for (a, b), n in Counter((w[0], w[-1]) for w in walks(k)).items():
            if a != b:
                out.setdefault((a, b), (k, n))
    return out


def counted(ws):
    return sorted(((*e, n) for e, n in Counter((w[0], w[-1]) for w in ws).items()), key=repr)


def test_paths_see_light_transitions(spark, d):
    q = lambda name: rows(QUERIES[name](spark, d))
    short = walks(1) + walks(2)
    assert q("g_path_1_3_arbitrary") == sorted(((w[0], w[-1]) for w in short), key=repr)
    assert q("g_path_simple") == counted(w for w in walks(3) if len(set(w)) == 4)
    assert q("g_path_trail") == counted(w for w in walks(3) if len(set(zip(w, w[1:]))) == 3)
    assert q("g_shortest_length") == sorted(((*e, k) for e, (k, _) in distances().items()), key=repr)
    assert q("g_all_shortest") == sorted(((*e, n) for e, (k, n) in distances().items() if k < 3), key=repr)
    assert q("cy_var_length") == sorted(((a, len({w[-1] for w in short if w[0] == a}), sum(w[0] == a for w in short)) for a in {w[0] for w in short}), key=repr)
    assert q("cy_shortest") == sorted(Counter(k for k, _ in distances().values()).items(), key=repr)
    cycles = sum(w[0] == w[-1] for w in walks(3))
    assert cycles > 0 and q("g_triangle") == q("gr_match") == [(cycles,)]
    assert q("gr_path_expand") == [(len(short),)]
    assert q("gr_path_simple") == [(sum(w[0] != w[-1] for w in walks(2)),)]
    assert {r[:2] for r in q("s_undirected")} == {*PAIRS, *((b, a) for a, b in PAIRS)}


def parts(pairs, without=None):
    left, n = {v for p in pairs for v in p} - {without}, 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            at = todo.pop()
            near = {v for p in pairs if at in p for v in p} & left
            left -= near
            todo += near
    return n


def test_biconnectivity_sees_light_transitions(spark, d):
    both = {(min(p), max(p)) for p in PAIRS}
    vertices = {v for p in both for v in p}
    bridge = [p for p in both if parts((both - {p}) | {(v, v) for v in vertices}) > parts(both)]
    assert rows(QUERIES["a_bridges"](spark, d)) == sorted(bridge, key=repr)
    cut = [(v,) for v in vertices if parts({p for p in both if v not in p} | {(x, x) for x in vertices - {v}}) > parts(both)]
    assert rows(QUERIES["a_cut_points"](spark, d)) == sorted(cut, key=repr)
    degree = Counter(v for p in both for v in p)
    layers, core, layer = [], 0, 0
    while degree:
        core, layer = max(core, min(degree.values())), layer + 1
        gone = {v for v, n in degree.items() if n <= core}
        layers += [(v, core, layer) for v in gone]
        both = {p for p in both if not gone & set(p)}
        degree = {v: sum(v in p for p in both) for v in degree if v not in gone}
    assert rows(QUERIES["a_onion"](spark, d)) == sorted(layers, key=repr)


def test_joins_see_all_ids(spark, d):
    q = lambda name: {r[0] for r in rows(QUERIES[f"g_join_{name}"](spark, d))}
    left, right = set(CUSTOMERS), set(SUPPLIERS)
    assert q("inner") == q("semi") == left & right
    assert q("left") == left and q("right") == right and q("full") == left | right and q("anti") == left - right
    sides = {r.k: (r.n, r.m) for r in QUERIES["g_join_full"](spark, d).collect()}
    assert sides == {k: (k % 2 if k in left else None, k % 2 if k in right else None) for k in left | right}


def test_all_vertices_are_seeds(spark, d):
    q = lambda name: rows(QUERIES[name](spark, d))
    assert max(Counter(a for a, _ in PAIRS).values()) <= 5  # so five neighbours are all
    for name in ("topk", "full", "weight", "in_degree"):
        assert q(f"l_neighbor_{name}") == sorted(PAIRS, key=repr), name
    hops = q("l_hops")
    assert {(s, t) for _, s, t in hops} <= set(PAIRS)
    assert Counter(s for h, s, _ in hops if h == 1) == {a: 4 for a, _ in PAIRS}
    reached = {t for h, _, t in hops if h == 1}
    assert Counter(s for h, s, _ in hops if h == 2) == {a: 2 for a, _ in PAIRS if a in reached}
