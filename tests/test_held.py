import random
from collections import Counter
from fractions import Fraction

import pytest

from loomgraph import session
from loomgraph.graph import Graph
from loomgraph.operators import algorithms as al
from loomgraph.operators import held
from loomgraph.plans.cypher import cypher
from loomgraph.plans.rows import Rows

from .conftest import rows


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")


def some_graph(seed, n=90, m=420, loops=False):
    """Edges of three parts of unlike sizes, with vertices that only begin or end edges."""
    draw = random.Random(seed)
    part = lambda v: 0 if v < 70 else v % 2 + 1
    found = {(a, b) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(m)) if part(a) == part(b)}
    return sorted((a, b) for a, b in found if loops or a != b)


def distances(pairs):
    """Breadth first from every vertex."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, []).append(b)
    out = {}
    for s in {v for p in pairs for v in p}:
        out[s, s], front = 0, [s]
        while front:
            front = [b for a in front for b in to.get(a, []) if (s, b) not in out and not out.update({(s, b): out[s, a] + 1})]
    return out


@pytest.fixture(params=["held", "joined"])
def limit(request, monkeypatch):
    """Both ways to search: over arrays, and by joins as for graphs that workers can't hold."""
    if request.param == "joined":
        monkeypatch.setattr(held, "HELD", 0)


@pytest.fixture
def written(monkeypatch):
    """The frames that are written."""
    out, new = [], session._new_path
    monkeypatch.setattr(session, "_new_path", lambda spark: out.append(1) or new(spark))
    return out


def near(got, wanted):
    assert {k for k, _ in got} == set(wanted) and all(abs(x - float(wanted[k])) < 1e-9 for k, x in got)


def test_all_pairs_by_brute_force(spark, limit):
    pairs = some_graph(1)
    e, d = frame(spark, pairs), distances(pairs)
    ids = {s for s, _ in d}
    assert rows(al.all_pairs_shortest_path_length(e, weighted=False)) == sorted(((a, b, float(k)) for (a, b), k in d.items()), key=repr)
    assert rows(al.all_pairs_shortest_path_length(e, spark.createDataFrame([(3,), (777,)], "id long"), weighted=False)) == sorted([(3, b, float(k)) for (a, b), k in d.items() if a == 3] + [(777, 777, 0.0)], key=repr)
    assert abs(al.average_shortest_path_length(e).first().value - sum(d.values()) / (len(ids) * (len(ids) - 1))) < 1e-9
    into = {v: [k for (_, b), k in d.items() if b == v] for v in ids}
    near(rows(al.closeness_centrality(e)), {v: Fraction((len(x) - 1) ** 2, sum(x) * (len(ids) - 1)) if sum(x) else 0 for v, x in into.items()})
    u = distances(pairs + [(b, a) for a, b in pairs])
    near(rows(al.harmonic_centrality(e)), {v: sum(Fraction(1, k) for (_, b), k in u.items() if b == v and k) for v in ids})


def test_shortest_lengths_by_brute_force(spark, limit):
    pairs = some_graph(2)
    g, d = Graph.from_edges({("V", "e", "V"): frame(spark, pairs)}), distances(pairs)
    wanted = lambda most: sorted(((a, b, k) for (a, b), k in d.items() if 0 < k <= most), key=repr)
    lengths = lambda upper, **k: rows(Rows.scan(g, "a", ["V"]).shortest_lengths("a", "b", upper, ["e"], path="p", **k).df.select("a", "b", "p__length"))
    assert lengths(4) == wanted(3) and lengths(None) == wanted(99) and lengths(1) == []
    assert lengths(4, direction="in") == sorted(((b, a, k) for a, b, k in wanted(3)), key=repr)
    text = "MATCH p = shortestPath((a:V)-[:e*1..4]->(b:V)) RETURN length(p) AS k, count(*) AS n"
    counts = Counter(k for _, _, k in wanted(3))
    assert rows(cypher(g, text)) == sorted(counts.items(), key=repr)
    assert rows(cypher(g, text.replace("RETURN", "WHERE a.id < 5 AND length(p) > 1 RETURN"))) == sorted(Counter(k for a, _, k in wanted(3) if a < 5 and k > 1).items(), key=repr)
    assert rows(cypher(g, text.replace("count(*) AS n", "nodes(p) AS n").replace("RETURN", "WHERE a.id = 3 AND b.id < 9 RETURN"))) == rows(cypher(g, text.replace("count(*)", "nodes(p)").replace("(a:V)", "(a:V {id: 3})").replace("RETURN", "WHERE b.id < 9 RETURN")))


def test_lengths_are_counted_without_their_ends(spark, monkeypatch):
    pairs = some_graph(2)
    g, d = Graph.from_edges({("V", "e", "V"): frame(spark, pairs)}), distances(pairs)
    q = lambda text: rows(cypher(g, f"MATCH p = shortestPath((a:V)-[:e*1..4]->(b:V)) {text}"))
    reach = Counter(b for (_, b), k in d.items() if 0 < k < 4)
    assert q("RETURN b.id AS b, count(*) AS n") == sorted(reach.items(), key=repr)
    monkeypatch.setattr(held, "pairs", None)
    assert q("RETURN length(p) AS k, count(*) AS n") == sorted(Counter(k for k in d.values() if 0 < k < 4).items(), key=repr)
    assert q("WHERE length(p) > 1 RETURN a.id AS a, count(*) AS n, max(length(p)) AS k") == sorted(((s, sum(1 for (a, _), k in d.items() if a == s and 1 < k < 4), max(k for (a, _), k in d.items() if a == s and k < 4)) for s in {a for (a, _), k in d.items() if 1 < k < 4}), key=repr)


def test_paths_of_three_steps_by_listing_them(spark):
    once = some_graph(3, 40, 200, loops=True)
    for pairs in (once, [p for p in once if p[0] != p[1]], once + once[::3] + once[::9]):
        g = Graph.from_edges({("V", "e", "V"): frame(spark, pairs)})
        for option in ("simple", "trail"):
            listed = Counter((r.a, r.b) for r in Rows.scan(g, "a", ["V"]).path_expand("a", "b", 3, 4, ["e"], option=option).df.collect())
            assert rows(Rows.scan(g, "a", ["V"]).path_counts("a", "b", 3, ["e"], option=option)) == sorted(((a, b, n) for (a, b), n in listed.items()), key=repr)


def test_searches_from_everywhere_write_no_rounds(spark, written):
    e = frame(spark, [(k, k + 1) for k in range(30)])
    assert al.closeness_centrality(e).count() == 31
    assert al.harmonic_centrality(e).count() == 31
    assert al.average_shortest_path_length(e).first().value > 0
    assert al.all_pairs_shortest_path_length(e, weighted=False).count() == 31 * 32 / 2
    g = Graph.from_edges({("V", "e", "V"): e})
    assert Rows.scan(g, "a", ["V"]).shortest_lengths("a", "b", None, ["e"], path="p").df.count() == 31 * 30 / 2
    assert Rows.scan(g, "a", ["V"]).path_counts("a", "b", 3, ["e"]).count() == 28
    assert cypher(g, "MATCH p = shortestPath((a:V)-[:e*1..31]->(b:V)) RETURN length(p) AS k, count(*) AS n").count() == 30
    assert len(written) < 16


def test_shells_are_peeled(spark, monkeypatch):
    pairs = [(a, b) for a, b in some_graph(4, 90, 500) if a < 70] + [(200, 201), (201, 202)]
    core = {r.id: r.core for r in al.core_numbers(frame(spark, pairs)).collect()}
    monkeypatch.setattr(al, "core_numbers", None)
    for k in (None, 1, 2, max(core.values()), 99):
        assert rows(al.k_shell(frame(spark, pairs), k)) == sorted(((v,) for v, c in core.items() if c == (min(core.values()) if k is None else k)), key=repr)
    for k in (0, 2, 3):
        assert rows(al.k_core(frame(spark, pairs), k)) == sorted(((v,) for v, c in core.items() if c >= k), key=repr)
