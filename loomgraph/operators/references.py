"""References to records that do not exist, over composite keys with partial nulls and validity in time.

A reference is a key tuple and the time at which it was made. Its null mask says which key columns it fills in, and
under MATCH PARTIAL only those have to match (MATCH SIMPLE: a key with any null holds; MATCH FULL: a key with some but
not all nulls does not hold). References are grouped by mask, and every group is anti-joined with the targets on
exactly its non-null columns and on the interval in which a target is in force.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTIAL, SIMPLE, FULL = "partial", "simple", "full"


def in_force(versions: DataFrame, owner: list[str]) -> DataFrame:
    """Intervals `[valid_from, valid_to)` in which each version is its owner's version in force.

    `versions` has the owner columns, `version_id, defined_at, dropped_at`, one row per version; other columns are
    kept. In force at a time is the highest version defined by then, unless dropped by then. The window streams over
    one owner's sorted versions and spills; nothing of an owner is held in memory. Rows without a defined_at or a
    version_id are never in force.
    """
    w = Window.partitionBy(*owner).orderBy("defined_at", "version_id")
    later = Window.partitionBy(*owner).orderBy(F.desc("defined_at"), F.desc("version_id"))
    v = versions.where("defined_at is not null and version_id is not null")
    top = v.withColumn("_top", F.max("version_id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = top.where("version_id = _top").drop("_top")  # a lower version that comes later is never the highest
    return (
        own.withColumn("_next", F.lag("defined_at").over(later))
        .withColumn("valid_from", F.col("defined_at"))
        .withColumn("valid_to", F.least("_next", "dropped_at"))  # least skips nulls: open end
        .where("valid_to is null or valid_to > valid_from")
        .drop("_next")
    )


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], at: str, match: str = PARTIAL, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `refs` whose key is not met by any row of `targets` in force at the time in column `at`.

    `targets` has the key columns and `valid_from, valid_to` (null: without end). A null time meets no interval. Keys
    that are null altogether refer to nothing and hold. Repeated references all come out; extra columns are kept, and
    columns of `targets` other than the keys can't clash as they aren't part of the result.
    """
    if match not in (PARTIAL, SIMPLE, FULL):
        raise ValueError(f"unknown match semantics: {match}")
    parts = []
    for mask in product(*[(True,) if k in required else (True, False) for k in keys]):
        filled = [k for k, has in zip(keys, mask) if has]
        if not filled or (match == SIMPLE and len(filled) < len(keys)):
            continue
        group = refs
        for k, has in zip(keys, mask):
            group = group.where(F.col(k).isNotNull() if has else F.col(k).isNull())
        if match == FULL and len(filled) < len(keys):
            parts.append(group)
            continue
        t = targets.select(*[F.col(k).alias(f"_t_{k}") for k in filled], F.col("valid_from").alias("_t_from"), F.col("valid_to").alias("_t_to")).distinct()
        on = (F.col("_t_from") <= F.col(at)) & (F.col("_t_to").isNull() | (F.col("_t_to") > F.col(at)))
        for k in filled:
            on = on & (F.col(k) == F.col(f"_t_{k}"))
        parts.append(group.join(t, on, "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_versions(type_def: DataFrame) -> DataFrame:
    """One row per version of a vertex type with the names of its properties; repeated deliveries fold into one."""
    entry = "array<struct<name:string,property_name:string>>"
    names = F.transform(F.from_json("props", entry), lambda e: F.coalesce(e["name"], e["property_name"]))
    return (
        type_def.where("type_enum = 'VERTEX'")
        .groupBy("graph_id", "label", "version_id")
        .agg(
            F.min("defined_at").alias("defined_at"),
            F.min("dropped_at").alias("dropped_at"),
            F.min_by("props", F.struct("arrived_at", "def_id")).alias("props"),
        )
        .withColumn("names", F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))
        .drop("props")
    )


def label_references(edge_kind: DataFrame) -> DataFrame:
    """References of edge kinds to the vertex types at their ends, one row per distinct reference."""
    ends = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("label")) for c in ("src_vertex_label", "dst_vertex_label")])
    )
    return (
        edge_kind.select(F.col("edge_kind_id").alias("record_id"), "graph_id", "created_at", ends.alias("r"))
        .select(F.lit("edge_kind").alias("table_name"), "record_id", "graph_id", "created_at", "r.field_name", "r.label", F.lit(None).cast("string").alias("property"))
        .where("label is not null")
        .distinct()
    )


def mapping_references(edge_datasource: DataFrame) -> DataFrame:
    """References of the mapping entries of data sources to properties of their vertex types."""
    entry = "array<struct<property:string>>"
    sides = [
        F.struct(F.lit(f"{side}_vertex_mappings").alias("field_name"), F.col(f"{side}_vertex").alias("label"), F.from_json(f"{side}_vertex_mappings", entry).alias("entries"))
        for side in ("source", "destination")
    ]
    return (
        edge_datasource.select(F.col("mapping_id").alias("record_id"), "graph_id", "created_at", F.explode(F.array(*sides)).alias("r"))
        .select("record_id", "graph_id", "created_at", "r.field_name", "r.label", F.explode("r.entries").alias("e"))
        .select(F.lit("edge_datasource").alias("table_name"), "record_id", "graph_id", "created_at", "field_name", "label", F.col("e.property").alias("property"))
        .where("property is not null")
        .distinct()
    )


def missing_references(type_def: DataFrame, edge_kind: DataFrame, edge_datasource: DataFrame) -> DataFrame:
    """References that do not hold, with their state (never, gone, later) and month.

    Null labels and properties refer to nothing. A reference without a graph or a time can't hold: it is `later` if
    some version of the same graph has what it names, else `never`; its period is null where the time is. A property
    of a null vertex type is `never`, with only the property in ref_key's second half. Properties files that are not
    JSON define no properties.
    """
    versions = type_versions(type_def)
    refs = label_references(edge_kind).unionByName(mapping_references(edge_datasource))
    live = in_force(versions, ["graph_id", "label"])
    targets = live.select("graph_id", "label", F.lit(None).cast("string").alias("property"), "valid_from", "valid_to").unionByName(
        live.select("graph_id", "label", F.explode("names").alias("property"), "valid_from", "valid_to")
    )
    # a reference always needs its graph and label; only the property may be left open
    complete = refs.where("graph_id is not null and label is not null")
    partial = refs.where("graph_id is null or label is null")
    bad = orphans(complete, targets, ["graph_id", "label", "property"], "created_at", PARTIAL, ("graph_id", "label")).unionByName(partial)

    labels = versions.groupBy("graph_id", "label").agg(F.min("defined_at").alias("first")).withColumn("property", F.lit(None).cast("string"))
    properties = (
        versions.select("graph_id", "label", F.explode("names").alias("property"), "defined_at")
        .groupBy("graph_id", "label", "property")
        .agg(F.min("defined_at").alias("first"))
    )
    known = labels.unionByName(properties).select(
        F.col("graph_id").alias("k_graph"), F.col("label").alias("k_label"), F.coalesce("property", F.lit("")).alias("k_property"), F.col("property").isNull().alias("k_open"), "first"
    )
    on = (
        (F.col("graph_id") == F.col("k_graph"))
        & (F.col("label") == F.col("k_label"))
        & (F.coalesce("property", F.lit("")) == F.col("k_property"))
        & (F.col("property").isNull() == F.col("k_open"))
    )
    state = F.when(F.col("first").isNull(), "never").when(F.col("first") <= F.col("created_at"), "gone").otherwise("later")
    return bad.join(known, on, "left").select(
        "table_name",
        "record_id",
        "field_name",
        F.when(F.col("property").isNull(), F.col("label")).otherwise(F.concat(F.coalesce("label", F.lit("")), F.lit("."), F.col("property"))).alias("ref_key"),
        state.alias("state"),
        F.date_format("created_at", "yyyy-MM").alias("period"),
    )
