import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import drift, parsing, references, skew

from .conftest import rows

T = datetime


def test_key_totals_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, None, "y"), (None, 5, "z"), (2, 7, "q")], "k long, o long, key_value string")
    assert rows(skew.key_totals(df, "k", "o")) == sorted([(1, 3, 1), (None, 1, 1), (2, 1, 1)], key=repr)
    assert skew.key_totals(df.limit(0), "k", "o").count() == 0
    assert skew.heavy_keys(df.limit(0), "k").count() == 0


def test_heavy_keys_counts_nulls_in_the_total_and_keeps_the_edge(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(2,)] + [(None,)] * 97, "k long")
    assert rows(skew.heavy_keys(df, "k").select("key_value")) == [(1,)]  # exactly 2 %


def test_missing_references(spark):
    day = lambda n: T(2025, 1, n)
    td = [
        (1, 9, "a", "VERTEX", 1, '[{"name":"x"}]', day(1), None, day(1)),
        (2, 9, "a", "VERTEX", 1, '[{"name": "x"}]', day(1), None, day(2)),
        (3, 9, "a", "VERTEX", 3, '[{"property_name":"y"}]', day(5), day(20), day(5)),
        (4, 9, "e", "EDGE", 1, "[]", day(1), None, day(1)),
        (5, 9, "b", "VERTEX", 1, "not json", day(10), None, day(10)),
    ]
    type_def = spark.createDataFrame(td, "def_id long, graph_id long, label string, type_enum string, version_id int, props string, defined_at timestamp, dropped_at timestamp, arrived_at timestamp")
    ek = [(1, 9, "a", "b", day(6)), (1, 9, "a", "b", day(6)), (2, 9, "a", "e", day(20)), (3, 8, "a", None, day(6)), (4, None, "a", None, day(6)), (5, 9, "a", "a", None)]
    edge_kind = spark.createDataFrame(ek, "edge_kind_id long, graph_id long, src_vertex_label string, dst_vertex_label string, created_at timestamp")
    ds = [(1, 9, "a", "a", '[{"property":"x"},{"property":"y"},{"property":null},{"column":{}}]', None, day(6)), (2, 9, None, "a", '[{"property":"x"}]', '[{"property":"y"}]', day(3))]
    edge_ds = spark.createDataFrame(ds, "mapping_id long, graph_id long, source_vertex string, destination_vertex string, source_vertex_mappings string, destination_vertex_mappings string, created_at timestamp")
    got = set(rows(references.missing_references(type_def, edge_kind, edge_ds)))
    assert got == {
        ("edge_kind", 1, "dst_vertex_label", "b", "later", "2025-01"),
        ("edge_kind", 2, "src_vertex_label", "a", "gone", "2025-01"),
        ("edge_kind", 2, "dst_vertex_label", "e", "never", "2025-01"),
        ("edge_kind", 3, "src_vertex_label", "a", "never", "2025-01"),
        ("edge_kind", 4, "src_vertex_label", "a", "never", "2025-01"),
        ("edge_kind", 5, "src_vertex_label", "a", "later", None),
        ("edge_kind", 5, "dst_vertex_label", "a", "later", None),
        ("edge_datasource", 1, "source_vertex_mappings", "a.x", "gone", "2025-01"),
        ("edge_datasource", 2, "source_vertex_mappings", ".x", "never", "2025-01"),
        ("edge_datasource", 2, "destination_vertex_mappings", "a.y", "later", "2025-01"),
    }
    assert references.missing_references(type_def.limit(0), edge_kind.limit(0), edge_ds.limit(0)).count() == 0


def test_match_semantics(spark):
    refs = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, None, None), (4, 2, None)], "i int, a int, b int").withColumn("at", F.lit(T(2025, 1, 1)).cast("timestamp"))
    targets = spark.createDataFrame([(1, 1)], "a int, b int").withColumn("valid_from", F.lit(T(2024, 1, 1)).cast("timestamp")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    left = lambda m: [r.i for r in references.orphans(refs, targets, ["a", "b"], "at", m).orderBy("i").collect()]
    assert left("partial") == [4] and left("simple") == [] and left("full") == [2, 4]


def test_edit_script_prefers_the_same_property_and_finds_moves():
    n = drift.Node
    cost, edits, _ = drift.edit_script([n("1", "a", "INT"), n("2", "b", "INT")], [n("2", "c", "LONG"), n("3", "a", "INT")])
    assert sorted((e.change, (e.new or e.old).name) for e in edits) == [("added", "a"), ("removed", "a"), ("renamed", "c"), ("retyped", "c")] and cost == 6
    _, edits, _ = drift.edit_script([n("1", "a", "INT"), n("2", "s", "STRUCT", [n("3", "x", "INT")])], [n("2", "s", "STRUCT", [n("3", "x", "INT"), n("1", "a", "INT")])])
    assert [(e.change, e.path) for e in edits] == [("moved", ("s",))]
    assert drift.edit_script([n(None, "a", "INT")], [n("1", "a", "INT")])[1] == []  # no ids on one side: by name


def test_schema_steps_skip_repeats_and_unify_rows(spark):
    at = [T(2025, 1, k) for k in range(1, 9)]
    td = [
        (1, 1, "v", "VERTEX", 1, '[{"id":1,"name":"a","data_type":4},{"id":2,"name":"b","data_type":"string"}]', at[0]),
        (2, 1, "v", "VERTEX", 1, "[]", at[1]),
        (3, 1, "v", "VERTEX", 4, '[{"id":2,"name":"c","data_type":8},{"id":1,"name":"a","data_type":"LONG"},{"id":3,"name":"b","data_type":7}]', at[2]),
        (4, 1, "w", "EDGE", 1, None, at[3]),
        (5, None, "w", "EDGE", 1, "[]", at[3]),
    ]
    type_def = spark.createDataFrame(td, "def_id long, graph_id long, label string, type_enum string, version_id int, props string, arrived_at timestamp")
    assert rows(drift.schema_changes(type_def)) == sorted([(1, "v", 4, "renamed", "c"), (1, "v", 4, "retyped", "a"), (1, "v", 4, "added", "b")], key=repr)
    vr = spark.createDataFrame([(1, 1, '{"a": 5, "b": "x", "zzz": 1}'), (2, 3, '{"c": "y", "b": 2.5}'), (3, 3, "broken"), (4, 99, "{}")], "row_id long, def_id long, payload string")
    plan = drift.projections(type_def)
    unified = drift.unified_rows(vr, type_def, plan)
    assert {r.row_id: r.properties for r in unified.collect()} == {1: {"a": "5", "c": "x"}, 2: {"c": "y", "b": "2.5"}, 3: {}, 4: {}}
    table = drift.type_table(unified, plan, 1, "v").orderBy("row_id").collect()
    assert [(r.row_id, r.a, r.b, r.c) for r in table] == [(1, 5, None, "x"), (2, None, 2.5, "y"), (3, None, None, None)]
    assert drift.schema_changes(type_def.limit(0)).count() == 0
    got = {r.row_id: {k: (v.kind, v.value) for k, v in r.properties.items()} for r in drift.typed_rows(vr, type_def).collect()}
    assert got == {1: {"a": ("LONG", "5"), "c": ("STRING", "x")}, 2: {"c": ("STRING", "y"), "b": ("DOUBLE", "2.5")}, 3: {}, 4: {}}


def split_strict(line, delim):
    """The fields as (value, quoted) by a reading of its own, None where the quoting is broken."""
    out, i = [], 0
    while True:
        if line.startswith('"', i):
            m = re.compile('"((?:[^"]|"")*)"').match(line, i)
            if not m or (m.end() < len(line) and not line.startswith(delim, m.end())):
                return None
            out.append((m[1].replace('""', '"'), True))
            i = m.end()
        else:
            k = line.find(delim, i)
            k = len(line) if k < 0 else k
            out.append((line[i:k], False))
            i = k
        if i >= len(line):
            return out
        i += len(delim)


def one_edit(s, delim):
    gone = {s[:i] + s[i + 1 :] for i in range(len(s)) if s[i] in ('"', delim)}
    return gone | {s[:i] + c + s[i:] for i in range(len(s) + 1) for c in ('"', delim)}


def is_sound(s, delim, fields):
    found = split_strict(s, delim)
    return found is not None and fields in (None, len(found))


def brute_cost(line, delim, fields):
    """Cheapest edits by search over all strings one edit away, as deep as it takes."""
    seen, cost = {line}, 0
    while not any(is_sound(s, delim, fields) for s in seen):
        seen, cost = {x for s in seen for x in one_edit(s, delim)}, cost + 1
    return cost


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='a",', max_size=6), st.sampled_from([1, 2, 3, None]))
def test_error_parse_is_the_cheapest(line, fields):
    cost, edits = parsing.error_parse(line, ",", fields)
    assert cost == len(edits) == brute_cost(line, ",", fields)
    out, done = [], 0  # the edits do repair the line
    for at, edit in edits:
        out.append(line[done:at])
        done = at + edit.startswith("delete")
        out.append("" if edit.startswith("delete") else '"' if edit == "insert_quote" else ",")
    assert is_sound("".join(out) + line[done:], ",", fields)


def test_error_parse_known_costs_and_long_lines():
    cost = lambda line, n: parsing.error_parse(line, ",", n)[0]
    assert cost(',"a', 1) == 2 and cost(",,,a", 1) == 2 and cost('"a"b,c', 3) == 1 and cost("a" * 10**6, 2) == 1
    assert cost("a," * 3000 + "a", 4) == 2 and cost("," * 3000, 4000) == 999 and cost('a"b' * 2000, 1) == 0
    assert parsing.error_parse('"a"|"b', "|", 2) == (1, [(6, "insert_quote")])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a",', max_size=9))
def test_sound_lines_split_alike(line):
    found = split_strict(line, ",")
    if found is not None:
        assert parsing.split_sound(line, ",") == found


def test_check_line_reasons():
    kinds = ["ID", "String", "Double"]
    reason = lambda s: parsing.check_line(s, ",", kinds)[0]
    assert reason('1,"a,""b",2.5\r') is None and parsing.check_line('1,"a,""b",2.5\r', ",", kinds)[3] == ["1", 'a,"b', "2.5"]
    assert reason('1,"a"x,2') == "quoting" and reason('1,"a') == "quoting" and reason("1,a") == "column_count" and reason(",a,1") == "value"
    assert reason('1,a"b,') is None and reason('1,a,""') == "value" and reason(None) == "column_count" and reason("") == "column_count"
    fits = parsing.fits
    assert fits("-2147483648", False, "Int32") and not fits("2147483648", False, "Int32") and not fits("+1", False, "Int32") and not fits("1" * 500, False, "Int64")
    assert fits("2024-02-29", False, "Date") and not fits("2023-02-29", False, "Date") and not fits("2023-01-01T24:00:00.000+0000", False, "DateTime")
    assert fits("007", False, "UInt64") and not fits("-1", False, "UInt64") and not fits("1e123", False, "Double") and fits("-1.5E+12", False, "Double") and not fits("٣", False, "Int32")


def test_parse_lines_and_typed_table(spark):
    files = spark.createDataFrame([(1, "id|n|n", "ID|Int32|Date", ",")], "file_id long, header string, columns string, delim string")
    data = [(1, 1, 1, "5,7,2024-01-02"), (2, 1, 2, "x,7,"), (3, 1, 3, None), (4, 9, 1, "a"), (5, 1, 4, "6,,")]
    lines = spark.createDataFrame(data, "row_id long, file_id long, line_no int, line string")
    parsed = parsing.parse_lines(lines, files)
    assert rows(parsing.rejected(parsed)) == [(2, "value"), (3, "column_count"), (4, "column_count")]
    t = parsing.typed_table(parsed, "id|n|n", "ID|Int32|Date", [1]).orderBy("row_id").collect()
    assert [(r.id, r.n, str(r.n_2)) for r in t] == [(5, 7, "2024-01-02"), (6, None, "None")]
    assert parsing.parse_lines(lines.limit(0), files.limit(0)).count() == 0
