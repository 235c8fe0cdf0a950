"""Queries pN_ of the general operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, parsing, references, skew
from ..session import read

KEYS = (("cast_info", "person_id", "movie_id"), ("cast_info", "movie_id", "person_id"), ("movie_keyword", "movie_id", "keyword_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.missing_references(read(spark, d, "type_def"), read(spark, d, "edge_kind"), read(spark, d, "edge_datasource"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and state."""
    return p2_found(spark, d).groupBy("table_name", "period", "state").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("record_id").alias("n_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(read(spark, d, "type_def"))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every vertex row under the columns of its type, with each value in its column's type, as JSON with sorted keys."""
    rows = drift.typed_rows(read(spark, d, "vertex_row"), read(spark, d, "type_def"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("properties")))
    return rows.select("row_id", "graph_id", "label", "version_id", F.to_json(ordered).alias("properties"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([skew.named(skew.heavy_keys(read(spark, d, t), key), t, key).drop("n_rows") for t, key, _ in KEYS])


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct counterparts of every key."""
    return _union([skew.named(skew.key_totals(read(spark, d, t), key, other), t, key) for t, key, other in KEYS])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rejected(parsing.parse_lines(read(spark, d, "col_row"), read(spark, d, "col_file")))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its verdict, the cost and edits of its cheapest repair, and its values if it loads."""
    return parsing.parse_lines(read(spark, d, "col_row"), read(spark, d, "col_file"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_rows, p4_found, p4_keys, p5_found, p5_lines)}

_P2 = """
WITH v AS (
  SELECT graph_id, label, version_id, min(defined_at) AS defined_at, min(dropped_at) AS dropped_at, arg_min(props, (arrived_at, def_id)) AS props
  FROM type_def WHERE type_enum = 'VERTEX' GROUP BY ALL
), names AS (
  SELECT graph_id, label, version_id, coalesce(e->>'name', e->>'property_name') AS property
  FROM (SELECT *, unnest(from_json(props, '["JSON"]')) AS e FROM v)
), refs AS (
  SELECT DISTINCT 'edge_kind' AS table_name, edge_kind_id AS record_id, graph_id, created_at, f AS field_name, l AS label, NULL::VARCHAR AS property
  FROM (SELECT *, unnest(['src_vertex_label', 'dst_vertex_label']) AS f, unnest([src_vertex_label, dst_vertex_label]) AS l FROM edge_kind) WHERE l IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'edge_datasource', mapping_id, graph_id, created_at, f, l, e->>'property'
  FROM (SELECT mapping_id, graph_id, created_at, f, l, unnest(from_json(m, '["JSON"]')) AS e FROM (
    SELECT *, unnest(['source_vertex_mappings', 'destination_vertex_mappings']) AS f, unnest([source_vertex, destination_vertex]) AS l,
      unnest([source_vertex_mappings, destination_vertex_mappings]) AS m FROM edge_datasource))
  WHERE e->>'property' IS NOT NULL
), cand AS (
  SELECT r.*, v.version_id, v.defined_at, v.dropped_at,
    CASE WHEN v.version_id IS NULL THEN false WHEN r.property IS NULL THEN true
      ELSE EXISTS (SELECT 1 FROM names n WHERE n.graph_id = v.graph_id AND n.label = v.label AND n.version_id = v.version_id AND n.property = r.property) END AS has
  FROM refs r LEFT JOIN v ON v.graph_id = r.graph_id AND v.label = r.label
), agg AS (
  SELECT table_name, record_id, graph_id, created_at, field_name, label, property,
    arg_max(has AND coalesce(dropped_at > created_at, true), version_id) FILTER (WHERE defined_at <= created_at) AS holds,
    coalesce(bool_or(has AND defined_at <= created_at), false) AS past, coalesce(bool_or(has AND defined_at > created_at), false) AS future
  FROM cand GROUP BY ALL
)
SELECT table_name, record_id, field_name, CASE WHEN property IS NULL THEN label ELSE coalesce(label, '') || '.' || property END AS ref_key,
  CASE WHEN past THEN 'gone' WHEN future THEN 'later' ELSE 'never' END AS state, strftime(created_at, '%Y-%m') AS period
FROM agg WHERE NOT coalesce(holds, false)
"""

_P3 = """
WITH v AS (
  SELECT *, lag(version_id) OVER w AS before FROM (
    SELECT * FROM type_def QUALIFY row_number() OVER (PARTITION BY graph_id, label, version_id ORDER BY arrived_at, def_id) = 1
  ) WINDOW w AS (PARTITION BY graph_id, label ORDER BY version_id)
), e AS (
  SELECT graph_id, label, version_id, before, coalesce(x->>'id', x->>'property_id') AS pid, coalesce(x->>'name', x->>'property_name') AS name,
    coalesce(x->>'data_type', (x->'property_type')->>'primitive_type',
      CASE WHEN ((x->'property_type')->'string') IS NOT NULL THEN 'STRING' ELSE json_keys((x->'property_type')->'temporal')[1] END) AS raw
  FROM (SELECT *, unnest(from_json(props, '["JSON"]')) AS x FROM v)
), p AS (
  SELECT * EXCLUDE (raw), CASE upper(raw) WHEN '4' THEN 'INT' WHEN 'DT_SIGNED_INT32' THEN 'INT' WHEN '5' THEN 'LONG' WHEN 'DT_SIGNED_INT64' THEN 'LONG'
    WHEN '16' THEN 'UINT' WHEN 'DT_UNSIGNED_INT32' THEN 'UINT' WHEN '17' THEN 'ULONG' WHEN 'DT_UNSIGNED_INT64' THEN 'ULONG' WHEN '6' THEN 'FLOAT'
    WHEN 'DT_FLOAT' THEN 'FLOAT' WHEN '7' THEN 'DOUBLE' WHEN 'DT_DOUBLE' THEN 'DOUBLE' WHEN '1' THEN 'BOOL' WHEN 'DT_BOOL' THEN 'BOOL' WHEN '8' THEN 'STRING'
    WHEN '19' THEN 'DATE32' WHEN '30' THEN 'TIMESTAMP_MS' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_MS' ELSE upper(raw) END AS kind FROM e
), ids AS (SELECT graph_id, label, version_id, bool_and(pid IS NOT NULL) AS has_ids FROM p GROUP BY ALL
), pairs AS (
  SELECT v.graph_id, v.label, v.version_id, v.before, coalesce(a.has_ids, false) AND coalesce(b.has_ids, false) AS by_id FROM v
  LEFT JOIN ids a ON (a.graph_id, a.label, a.version_id) = (v.graph_id, v.label, v.version_id)
  LEFT JOIN ids b ON (b.graph_id, b.label, b.version_id) = (v.graph_id, v.label, v.before) WHERE v.before IS NOT NULL
), o AS (SELECT q.graph_id, q.label, q.version_id, CASE WHEN by_id THEN p.pid ELSE p.name END AS k, p.name, p.kind FROM pairs q JOIN p ON (p.graph_id, p.label, p.version_id) = (q.graph_id, q.label, q.before)
), n AS (SELECT q.graph_id, q.label, q.version_id, CASE WHEN by_id THEN p.pid ELSE p.name END AS k, p.name, p.kind FROM pairs q JOIN p ON (p.graph_id, p.label, p.version_id) = (q.graph_id, q.label, q.version_id)
), j AS (SELECT coalesce(n.graph_id, o.graph_id) AS graph_id, coalesce(n.label, o.label) AS label, coalesce(n.version_id, o.version_id) AS version_id, o.name AS old, n.name AS new, o.kind AS ok, n.kind AS nk
  FROM o FULL JOIN n ON (o.graph_id, o.label, o.version_id, o.k) = (n.graph_id, n.label, n.version_id, n.k))
SELECT graph_id, label, version_id, 'added' AS change, new AS property_name FROM j WHERE old IS NULL
UNION ALL SELECT graph_id, label, version_id, 'removed', old FROM j WHERE new IS NULL
UNION ALL SELECT graph_id, label, version_id, 'renamed', new FROM j WHERE old <> new
UNION ALL SELECT graph_id, label, version_id, 'retyped', new FROM j WHERE ok <> nk
"""

_P4 = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, {k}::BIGINT AS key_value FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) * 50 >= (SELECT count(*) FROM {t})" for t, k, _ in KEYS
)
_P4_KEYS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, {k}::BIGINT AS key_value, count(*) AS n_rows, count(DISTINCT {o}) AS n_counterparts FROM {t} GROUP BY {k}" for t, k, o in KEYS
)

_P5 = r"""
WITH l AS (
  SELECT r.row_id, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS line, delim AS d,
    string_split(columns, '|') AS kinds, CASE delim WHEN '|' THEN '\|' ELSE delim END AS x
  FROM col_row r JOIN col_file f USING (file_id)
), q AS (
  SELECT *, '(?s)"(?:[^"]|"")*"' || x || '|(?s)[^"' || x || '][^' || x || ']*' || x || '|' || x AS field, line || d AS whole FROM l
), s AS (
  SELECT *, NOT regexp_full_match(whole, '(?s)(?:' || field || ')*') AS broken, regexp_extract_all(whole, field) AS f FROM q
), v AS (
  SELECT row_id, broken, len(f) <> len(kinds) AS miscounted, unnest(list_zip(f, kinds)) AS fk, length(d) AS n FROM s
), t AS (
  SELECT row_id, broken, miscounted, fk[2] AS k, left(fk[1], length(fk[1]) - n) AS raw,
    CASE WHEN left(fk[1], 1) = '"' THEN replace(substr(fk[1], 2, length(fk[1]) - n - 2), '""', '"') ELSE left(fk[1], length(fk[1]) - n) END AS val FROM v
), c AS (
  SELECT row_id, broken, miscounted, CASE
    WHEN k IS NULL OR k IN ('String', 'LCString') THEN false
    WHEN raw = '' THEN k = 'ID'
    WHEN k IN ('Int32', 'UInt32', 'Int64', 'UInt64', 'ID') THEN NOT regexp_full_match(val, '-?[0-9]+') OR coalesce(NOT CASE k
      WHEN 'Int32' THEN try_cast(val AS HUGEINT) BETWEEN -2147483648 AND 2147483647 WHEN 'UInt32' THEN try_cast(val AS HUGEINT) BETWEEN 0 AND 4294967295
      WHEN 'Int64' THEN try_cast(val AS HUGEINT) BETWEEN -9223372036854775808 AND 9223372036854775807
      WHEN 'UInt64' THEN try_cast(val AS HUGEINT) BETWEEN 0 AND 18446744073709551615 ELSE try_cast(val AS HUGEINT) BETWEEN 0 AND 9223372036854775807 END, true)
    WHEN k = 'Double' THEN NOT regexp_full_match(val, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?')
    WHEN k = 'Date' THEN NOT regexp_full_match(val, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(val AS DATE) IS NULL
    ELSE NOT regexp_full_match(val, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}\+0000') OR try_cast(left(val, 10) AS DATE) IS NULL END AS bad FROM t
)
SELECT row_id, CASE WHEN bool_or(broken) THEN 'quoting' WHEN bool_or(miscounted) THEN 'column_count' ELSE 'value' END AS reason
FROM c GROUP BY row_id HAVING bool_or(broken) OR bool_or(miscounted) OR bool_or(bad)
"""

SQL = {
    "p2_found": _P2,
    "p2_report": f"SELECT table_name, period, state, count(*) AS n_references, count(DISTINCT record_id) AS n_records FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3,
    "p4_found": _P4,
    "p4_keys": _P4_KEYS,
    "p5_found": _P5,
}
