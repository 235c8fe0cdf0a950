"""Gremlin texts with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..graph import film_graph, trade_graph
from ..plans.gremlin import gremlin
from .graph import _P, _user_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(name: str, text: str, sql: str | None, graph=trade_graph) -> None:
    QUERIES[name] = lambda spark, d: gremlin(graph(spark, d), text)
    if sql:
        SQL[name] = sql


_t("gr_v_label", "g.V().hasLabel('SUPPLIER')", "SELECT s_suppkey AS id, 'SUPPLIER' AS label FROM supplier")
_t("gr_has_values", "g.V().hasLabel('PART').has('p_size', gt(45)).values('p_brand')", "SELECT p_brand FROM part WHERE p_size > 45")
_t("gr_has_label_key_value", "g.V().has('NATION', 'n_regionkey', 2).values('n_name')", "SELECT n_name FROM nation WHERE n_regionkey = 2")
_t("gr_has_id", "g.V().hasLabel('CUSTOMER').hasId(1, 2, 3).values('c_name')", "SELECT c_name FROM customer WHERE c_custkey IN (1, 2, 3)")
_t("gr_has_not", "g.V().hasLabel('TITLE').hasNot('production_year').id()", "SELECT id FROM title WHERE production_year IS NULL", film_graph)
_t("gr_out_count", "g.V().hasLabel('CUSTOMER').out('PLACED').out('CONTAINS').count()", "SELECT count(*) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
_t("gr_in_dedup", "g.V().hasLabel('REGION').in('IN_REGION').in('IN_NATION').hasLabel('SUPPLIER').dedup().count()", "SELECT count(*) AS count FROM supplier")
_t("gr_out_e", "g.V().hasLabel('SUPPLIER').outE('SUPPLIES').has('n', gte(3)).inV().dedup().by('p_brand').values('p_brand')", "SELECT DISTINCT p_brand FROM part JOIN (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING n >= 3) ON l_partkey = p_partkey")
_t("gr_other_v", "g.V().hasLabel('NATION').bothE('IN_REGION').otherV().dedup().values('r_name')", "SELECT r_name FROM region")
_t("gr_both_v", "g.E().hasLabel('IN_REGION').bothV().groupCount().by(label)", "SELECT * FROM (VALUES ('NATION', 25::BIGINT), ('REGION', 25::BIGINT)) t(k0, v0)")
_t("gr_order_limit", "g.V().hasLabel('ORDERS').order().by('o_totalprice', desc).by(id).limit(7).id()", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
_t("gr_select_by", "g.V().hasLabel('SUPPLIER').as('s').out('IN_NATION').as('n').select('s', 'n').by('s_name').by('n_name')", "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey")
_t("gr_group_count", "g.V().hasLabel('CUSTOMER').groupCount().by('c_mktsegment')", "SELECT c_mktsegment AS k0, count(*) AS v0 FROM customer GROUP BY 1")
_t("gr_group_multi", "g.V().hasLabel('PART').group().by('p_brand', 'p_size').by(count(), values('p_retailprice').max())", "SELECT p_brand AS k0, p_size AS k1, count(*) AS v0, max(p_retailprice) AS v1 FROM part GROUP BY ALL")
_t("gr_group_set", "g.V().hasLabel('CUSTOMER').group().by('c_nationkey').by(values('c_mktsegment').dedup().fold())", "SELECT c_nationkey AS k0, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS v0 FROM customer GROUP BY 1")
_t("gr_where_semi", "g.V().hasLabel('PART').where(__.in('CONTAINS').has('o_orderstatus', 'P')).count()", "SELECT count(*) AS count FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'P')")
_t("gr_not", "g.V().hasLabel('PART').not(__.in('CONTAINS').has('o_orderstatus', 'F')).id()", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'F')")
_t("gr_where_tags", "g.V().hasLabel('SUPPLIER').as('a').out('IN_NATION').in('IN_NATION').hasLabel('SUPPLIER').as('b').where('a', neq('b')).count()", "SELECT count(*) AS count FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey <> b.s_suppkey")
_t("gr_where_expr", "g.V().hasLabel('PART').as('p').where(expr(p.p_size > 40 && p.p_retailprice < 1000)).id()", "SELECT p_partkey AS id FROM part WHERE p_size > 40 AND p_retailprice < 1000")
_t("gr_union", "g.V().hasLabel('NATION').union(out('IN_REGION'), __.in('IN_NATION')).groupCount().by(label)", "SELECT 'REGION' AS k0, count(*) AS v0 FROM nation UNION ALL SELECT 'CUSTOMER', count(*) FROM customer UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier")
_t("gr_aggregates", "g.V().hasLabel('CUSTOMER').values('c_nationkey').max()", "SELECT max(c_nationkey) AS max FROM customer")
_t("gr_text", "g.V().hasLabel('PART').has('p_type', TextP.startingWith('S')).has('p_name', TextP.notContaining('1')).has('p_size', P.inside(5, 20)).id()", "SELECT p_partkey AS id FROM part WHERE p_type LIKE 'S%' AND p_name NOT LIKE '%1%' AND p_size > 5 AND p_size < 20")
_t("gr_predicate_or", "g.V().hasLabel('PART').has('p_size', lt(3).or(gt(48))).has('p_brand', within('Brand#11', 'Brand#12', 'Brand#23')).id()", "SELECT p_partkey AS id FROM part WHERE (p_size < 3 OR p_size > 48) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
_t("gr_path_expand", "g.V().out('1..3', 'NEXT').count()", f"{_P} SELECT (SELECT count(*) FROM h) + (SELECT count(*) FROM h x JOIN h y ON x.dst = y.src) AS count", _user_graph)
_t("gr_path_simple", "g.V().out('2..3', 'NEXT').with('PATH_OPT', 'SIMPLE').count()", f"{_P} SELECT count(*) AS count FROM h x JOIN h y ON x.dst = y.src WHERE x.src <> y.dst", _user_graph)
_t("gr_match", "g.V().hasLabel('USER').match(__.as('a').out('NEXT').as('b'), __.as('b').out('NEXT').as('c'), __.as('c').out('NEXT').as('a')).count()", f"{_P} SELECT count(*) AS count FROM h x JOIN h y ON x.dst = y.src JOIN h z ON y.dst = z.src AND z.dst = x.src", _user_graph)
_t("gr_by_traversal", "g.V().hasLabel('CUSTOMER').as('c').select('c').by(out('PLACED').count())", "SELECT count(o_orderkey) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_t("gr_element_map", "g.V().hasLabel('REGION').elementMap('r_name')", None)
_t("gr_both", "g.V().hasLabel('NATION').both('IN_REGION', 'IN_NATION').groupCount().by(label)", "SELECT 'REGION' AS k0, count(*) AS v0 FROM nation UNION ALL SELECT 'CUSTOMER', count(*) FROM customer UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier")
_t("gr_in_e", "g.V().hasLabel('PART').inE('CONTAINS').has('quantity', eq(7.0)).outV().dedup().id()", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity = 7")
_t("gr_is", "g.V().hasLabel('PART').values('p_size').is(outside(3, 48)).identity()", "SELECT p_size FROM part WHERE p_size < 3 OR p_size > 48")
_t("gr_constant", "g.V().hasLabel('REGION').constant('x')", "SELECT 'x' AS constant FROM region")
_t("gr_sum_mean", "g.V().hasLabel('PART').values('p_size').sum()", "SELECT sum(p_size)::BIGINT AS sum FROM part")
_t("gr_min", "g.V().hasLabel('PART').values('p_size').min()", "SELECT min(p_size) AS min FROM part")
_t("gr_text_more", "g.V().hasLabel('PART').has('p_type', TextP.notStartingWith('S')).has('p_name', TextP.containing('1')).has('p_brand', TextP.endingWith('3')).has('p_type', TextP.notEndingWith('X')).id()", "SELECT p_partkey AS id FROM part WHERE p_type NOT LIKE 'S%' AND p_name LIKE '%1%' AND p_brand LIKE '%3' AND p_type NOT LIKE '%X'")
_t("gr_predicates_more", "g.V().hasLabel('PART').has('p_size', lte(10)).has('p_brand', without('Brand#11', 'Brand#12')).has('p_size', P.not(eq(4))).id()", "SELECT p_partkey AS id FROM part WHERE p_size <= 10 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_size <> 4")
_t("gr_where_by", "g.V().hasLabel('CUSTOMER').as('a').out('IN_NATION').in('IN_NATION').hasLabel('SUPPLIER').as('b').where('a', lt('b')).by('c_acctbal').by('s_acctbal').count()", "SELECT count(*) AS count FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal < s_acctbal")
_t("gr_sample_count", "g.V().hasLabel('CUSTOMER').sample(10).count()", "SELECT 10::BIGINT AS count")
_t("gr_coin_all", "g.V().hasLabel('CUSTOMER').coin(1.0).count()", "SELECT count(*) AS count FROM customer")
_t("gr_coin", "g.V().hasLabel('CUSTOMER').coin(0.5).count()", None)
_t("gr_sample", "g.V().hasLabel('CUSTOMER').sample(10).id()", None)
