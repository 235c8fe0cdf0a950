"""Schemas that drift between files: edit scripts between versions, and one consistent table per type.

A schema is a tree. Two successive versions are compared by tree edit distance in which whole subtrees are inserted
and deleted (Selkow's model): children are aligned by dynamic programming, a pair of children that are the same
property costs 1 for another name and 1 for another type plus the distance of their subtrees, any other pair always costs
more than a deletion and an insertion. Children are first put in the order of their identities, as their order in a
file has no meaning, so the cheapest script is the exact one. A subtree that is deleted in one place and inserted in
another under the same identity is a move. The scripts chain the versions of a property into a lineage, and lineages
compile into projections that bring every file's rows into one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The logical types by enum number, by enum name and by primitive type.
TYPE_NUMBERS = {1: "BOOL", 4: "INT", 5: "LONG", 6: "FLOAT", 7: "DOUBLE", 8: "STRING", 16: "UINT", 17: "ULONG", 19: "DATE32", 30: "TIMESTAMP_MS"}
PRIMITIVES = {
    "DT_BOOL": "BOOL",
    "DT_SIGNED_INT32": "INT",
    "DT_SIGNED_INT64": "LONG",
    "DT_UNSIGNED_INT32": "UINT",
    "DT_UNSIGNED_INT64": "ULONG",
    "DT_FLOAT": "FLOAT",
    "DT_DOUBLE": "DOUBLE",
}
TEMPORALS = {"date32": "DATE32", "timestamp": "TIMESTAMP_MS"}
SPARK_TYPES = {"BOOL": "boolean", "INT": "int", "LONG": "bigint", "UINT": "bigint", "ULONG": "decimal(20,0)", "FLOAT": "float", "DOUBLE": "double", "STRING": "string", "DATE32": "date", "TIMESTAMP_MS": "timestamp"}
#: The types that a wider type holds without loss, narrowest first; what fits none becomes STRING.
WIDENINGS = (("LONG", ("INT", "UINT", "LONG")), ("ULONG", ("UINT", "ULONG")), ("DOUBLE", ("INT", "UINT", "FLOAT", "DOUBLE")))


@dataclass
class Node:
    """A property: its identity (id, or None where the file has no ids), name, logical type and nested properties."""

    key: str | None
    name: str
    kind: str
    children: list[Node] = field(default_factory=list)


def logical_type(raw: object) -> str:
    """The logical type of a data_type or property_type; unknown spellings stay as they are, in upper case."""
    if isinstance(raw, dict):
        if "primitive_type" in raw:
            return PRIMITIVES.get(raw["primitive_type"], str(raw["primitive_type"]))
        if "string" in raw:
            return "STRING"
        if isinstance(raw.get("temporal"), dict):
            kind = next(iter(raw["temporal"]), "")
            return TEMPORALS.get(kind, kind.upper())
        return "STRUCT" if "struct" in raw else json.dumps(raw, sort_keys=True)
    if isinstance(raw, int) and not isinstance(raw, bool):
        return TYPE_NUMBERS.get(raw, str(raw))
    text = str(raw).upper()
    return TYPE_NUMBERS.get(int(text), text) if text.isdecimal() else text


def parse_schema(text: str | None) -> list[Node]:
    """The properties of a file in either layout; what is no JSON list of objects has none. Nested lists are kept."""
    try:
        entries = json.loads(text) if text else []
    except ValueError:
        return []
    return _nodes(entries)


def _nodes(entries: object) -> list[Node]:
    out = []
    for e in entries if isinstance(entries, list) else []:
        if not isinstance(e, dict):
            continue
        name = e.get("name", e.get("property_name"))
        key = e.get("id", e.get("property_id"))
        raw = e.get("data_type", e.get("property_type"))
        nested = e.get("properties") or (raw.get("struct") if isinstance(raw, dict) else None) or []
        out.append(Node(None if key is None else str(key), "" if name is None else str(name), logical_type(raw), _nodes(nested)))
    return out


@dataclass
class Edit:
    """One step of a script; `path` is that of the parent, by new names."""

    change: str
    path: tuple[str, ...]
    old: Node | None
    new: Node | None


def edit_script(old: list[Node], new: list[Node]) -> tuple[int, list[Edit], list[tuple[Node, Node]]]:
    """Minimum-cost script between two forests: (cost, edits, matched pairs at the top level and below)."""
    by_key = all(n.key is not None for n in _walk(old)) and all(n.key is not None for n in _walk(new)) and bool(old) and bool(new)
    cost, edits, pairs = _align(old, new, by_key, ())
    return cost, _moves(edits, by_key), pairs


def _walk(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        yield n
        yield from _walk(n.children)


def _weight(n: Node) -> int:
    return 2 + sum(_weight(c) for c in n.children)


def _align(old: list[Node], new: list[Node], by_key: bool, path: tuple[str, ...]) -> tuple[int, list[Edit], list[tuple[Node, Node]]]:
    identity = (lambda n: n.key) if by_key else (lambda n: n.name)
    a, b = sorted(old, key=lambda n: (identity(n), n.name)), sorted(new, key=lambda n: (identity(n), n.name))
    da, db = [_weight(n) for n in a], [_weight(n) for n in b]
    cost = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    below: dict[tuple[int, int], tuple[int, list[Edit], list[tuple[Node, Node]]]] = {}
    for i in range(1, len(a) + 1):
        cost[i][0] = cost[i - 1][0] + da[i - 1]
    for j in range(1, len(b) + 1):
        cost[0][j] = cost[0][j - 1] + db[j - 1]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best = min(cost[i - 1][j] + da[i - 1], cost[i][j - 1] + db[j - 1])
            if identity(x) == identity(y):
                below[i, j] = _align(x.children, y.children, by_key, (*path, y.name)) if x.children or y.children else (0, [], [])
                best = min(best, cost[i - 1][j - 1] + (x.name != y.name) + (x.kind != y.kind) + below[i, j][0])
            cost[i][j] = best
    edits, pairs, i, j = [], [], len(a), len(b)
    while i or j:
        if i and j and (i, j) in below:
            x, y = a[i - 1], b[j - 1]
            if cost[i][j] == cost[i - 1][j - 1] + (x.name != y.name) + (x.kind != y.kind) + below[i, j][0]:
                if x.name != y.name:
                    edits.append(Edit("renamed", path, x, y))
                if x.kind != y.kind:
                    edits.append(Edit("retyped", path, x, y))
                pairs += [(x, y), *below[i, j][2]]
                edits += below[i, j][1]
                i, j = i - 1, j - 1
                continue
        if i and cost[i][j] == cost[i - 1][j] + da[i - 1]:
            edits.append(Edit("removed", path, a[i - 1], None))
            i -= 1
        else:
            edits.append(Edit("added", path, None, b[j - 1]))
            j -= 1
    return cost[-1][-1], edits, pairs


def _moves(edits: list[Edit], by_key: bool) -> list[Edit]:
    identity = (lambda n: n.key) if by_key else (lambda n: (n.name, n.kind))
    gone = {identity(e.old): e for e in edits if e.change == "removed"}
    out, moved = [], set()
    for e in edits:
        if e.change == "added" and (was := gone.get(identity(e.new))) and was.path != e.path:
            out.append(Edit("moved", e.path, was.old, e.new))
            moved.add(id(was))
        else:
            out.append(e)
    return [e for e in out if id(e) not in moved]


_STEPS = "graph_id long, label string, type_enum string, version_id int, def_id long, change string, property_name string, lineage string, kind string, ordinal int"


def schema_steps(type_def: DataFrame) -> DataFrame:
    """Walks the versions of each type in order and emits its changes and, per version, the lineage of its properties.

    Rows with a `change` are edits (property_name: the new name, for removed the old one); the others tell the lineage
    and type of each property of a version. Types are kept together and sorted, and the walk streams: it holds one
    version at a time, whatever the number of versions. Repeated deliveries of a version are skipped (the one that
    came first counts, by arrived_at and def_id), gaps in version numbers don't matter, and rows without a graph,
    label or version define nothing. Files that are no JSON list define no properties. Extra columns are ignored.
    """
    rows = (
        type_def.where("graph_id is not null and label is not null and version_id is not null")
        .select("graph_id", "label", "type_enum", "version_id", "arrived_at", "def_id", "props")
        .repartition("graph_id", "label")
        .sortWithinPartitions("graph_id", "label", "type_enum", "version_id", "arrived_at", "def_id")
        .drop("arrived_at")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner: tuple | None = None
        version: int | None = None
        before: list[Node] = []
        lineage: dict[int, str] = {}
        for b in batches:
            out: list[tuple] = []
            for graph, label, enum, ver, def_id, text in zip(b.graph_id, b.label, b.type_enum, b.version_id, b.def_id, b.props):
                first = (graph, label, enum) != owner
                if not first and ver == version:
                    continue
                now = parse_schema(text)
                head = (graph, label, enum, ver, def_id)
                edits, pairs = [], []
                if not first:
                    _, edits, pairs = edit_script(before, now)
                known = {id(n): lineage[id(o)] for o, n in pairs}
                lines = {}
                for k, n in enumerate(_walk(now)):
                    lines[id(n)] = known.get(id(n)) or f"{ver}.{k}"
                out += [(*head, e.change, (e.new or e.old).name, None, (e.new or e.old).kind, None) for e in edits]
                out += [(*head, None, n.name, lines[id(n)], n.kind, k) for k, n in enumerate(now)]
                owner, version, before, lineage = (graph, label, enum), ver, now, lines
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STEPS.split(", ")])

    return rows.mapInPandas(run, _STEPS)


def schema_changes(type_def: DataFrame) -> DataFrame:
    """Every change between a version of a type and the one before it."""
    return schema_steps(type_def).where("change is not null").select("graph_id", "label", "version_id", "change", "property_name")


def _widest(kinds: Column) -> Column:
    out = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
    for wide, within in WIDENINGS:
        out = out.when(F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in within]))) == 0, wide)
    return out.otherwise("STRING")


def projections(type_def: DataFrame) -> DataFrame:
    """Per version of a type, the compiled projection: `graph_id, label, version_id, def_id, property_name, column_name, kind`.

    A lineage's column has its latest name; where two lineages of a type end under one name, the one that lived
    longest keeps it and the others get the version and place they began at as a suffix. Its type is the narrowest
    that holds all types it had, else STRING.
    """
    steps = schema_steps(type_def).where("change is null")
    owner = ["graph_id", "label", "type_enum"]
    columns = steps.groupBy(*owner, "lineage").agg(
        F.max_by("property_name", "version_id").alias("last_name"), F.max("version_id").alias("last_version"), _widest(F.collect_set("kind")).alias("column_kind")
    )
    keeper = columns.groupBy(*owner, "last_name").agg(F.max_by("lineage", F.struct("last_version", "lineage")).alias("keeper"))
    columns = columns.join(keeper, [*owner, "last_name"]).withColumn(
        "column_name", F.when(F.col("lineage") == F.col("keeper"), F.col("last_name")).otherwise(F.concat_ws("__", "last_name", F.translate("lineage", ".", "_")))
    )
    return steps.join(columns.select(*owner, "lineage", "column_name", "column_kind"), [*owner, "lineage"]).select(
        "graph_id", "label", "type_enum", "version_id", "def_id", "property_name", "column_name", F.col("column_kind").alias("kind")
    )


def unified_rows(vertex_row: DataFrame, type_def: DataFrame, plan: DataFrame | None = None, kinds: bool = False) -> DataFrame:
    """Every row under its type's columns: `row_id, graph_id, label, version_id, properties` (map column -> text).

    With `kinds` also a map from column to its type.

    Keys a version doesn't define are dropped as unknown, columns a version lacks are absent, JSON nulls are null, a
    payload that is no JSON object has an empty map, and rows of an unknown def_id have a null type and an
    empty map. Repeated rows
    stay rows of their own.
    """
    plan = projections(type_def) if plan is None else plan
    compiled = plan.groupBy("def_id", "graph_id", "label", "version_id").agg(
        F.map_from_entries(F.collect_list(F.struct("property_name", "column_name"))).alias("to_column"), F.map_from_entries(F.collect_list(F.struct("column_name", "kind"))).alias("kinds")
    )
    compiled = compiled.withColumnRenamed("def_id", "_def")
    rows = vertex_row.select("row_id", "def_id", F.from_json("payload", "map<string,string>").alias("p"))
    joined = rows.join(compiled, F.col("def_id") == F.col("_def"), "left")
    kept = F.map_filter(F.coalesce("p", F.create_map().cast("map<string,string>")), lambda k, _: F.map_contains_key(F.col("to_column"), k))
    return joined.select("row_id", "graph_id", "label", "version_id", F.transform_keys(kept, lambda k, _: F.element_at("to_column", k)).alias("properties"), *(["kinds"] if kinds else []))


def typed(value: Column, kind: Column) -> Column:
    """A text in the spelling that its column's type gives it; null where it doesn't fit. Whole numbers that were written
    as such, numbers, truth values, days and milliseconds each have one spelling; other kinds stay as they are."""
    number = value.try_cast("decimal(38,0)").cast("string")
    out = F.when(kind.isin("INT", "LONG", "UINT", "ULONG"), F.when(value.rlike("^-?[0-9]+$"), number))
    out = out.when(kind.isin("FLOAT", "DOUBLE"), value.try_cast("double").cast("string"))
    out = out.when(kind == "BOOL", value.try_cast("boolean").cast("string"))
    out = out.when(kind == "DATE32", F.coalesce(F.date_from_unix_date(value.try_cast("int")), value.try_cast("date")).cast("string"))
    at = F.coalesce(F.timestamp_millis(value.try_cast("bigint")), value.try_cast("timestamp"))
    return out.when(kind == "TIMESTAMP_MS", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(value)


def typed_rows(vertex_row: DataFrame, type_def: DataFrame) -> DataFrame:
    """`unified_rows` with every value in its column's type: `properties` (map column -> struct of kind and value)."""
    rows = unified_rows(vertex_row, type_def, kinds=True)

    def value(name: Column, text: Column) -> Column:
        kind = F.element_at("kinds", name)
        return F.struct(kind.alias("kind"), typed(text, kind).alias("value"))

    return rows.select("row_id", "graph_id", "label", "version_id", F.transform_values("properties", value).alias("properties"))


def type_table(rows: DataFrame, plan: DataFrame, graph_id: int, label: str) -> DataFrame:
    """The consistent, typed table of one type. Values that don't fit their column's type are null."""
    own = (F.col("graph_id") == graph_id) & (F.col("label") == label)
    columns = plan.where(own).groupBy("column_name").agg(F.first("kind").alias("kind")).orderBy("column_name").collect()  # a type's properties
    out = [F.col("row_id"), F.col("version_id")]
    for c in columns:
        value = F.element_at("properties", F.lit(c.column_name))
        if c.kind == "TIMESTAMP_MS":
            value = F.coalesce(F.timestamp_millis(F.expr("1") * value.try_cast("bigint")), value.try_cast("timestamp"))
        elif c.kind == "DATE32":
            value = F.coalesce(F.date_from_unix_date(value.try_cast("int")), value.try_cast("date"))
        out.append(value.try_cast(SPARK_TYPES.get(c.kind, "string")).alias(c.column_name))
    return rows.where(own).select(*out)
