"""Readers and writers: tables from files, graphs from files, results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, Triplet


def load(spark: SparkSession, source: object, delimiter: str = ",", header_row: bool = True, filetype: str | None = None, column_types: str | None = None, **options: object) -> DataFrame:
    """A table from a path (any Hadoop file system: file, hdfs, s3, oss), a pandas frame, or a dict of arrays.

    CSV, ORC and Parquet by `filetype` or the path's ending; CSV without a header has columns f0, f1, ...; types are
    inferred unless `column_types` (a DDL schema) is given.
    """
    if not isinstance(source, str):
        import pandas as pd

        return spark.createDataFrame(source if isinstance(source, pd.DataFrame) else pd.DataFrame(source))
    kind = (filetype or source.rpartition(".")[2]).lower()
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(source)
    reader = spark.read.option("sep", delimiter).option("header", header_row).options(**{k: str(v) for k, v in options.items()})
    reader = reader.schema(column_types) if column_types else reader.option("inferSchema", True)
    df = reader.csv(source)
    return df if header_row else df.toDF(*[f"f{i}" for i in range(len(df.columns))])


def load_from(edges: dict[Triplet, DataFrame], vertices: dict[str, DataFrame] | None = None, directed: bool = True, generate_eid: bool = False, src: str | None = None, dst: str | None = None, vid: str | None = None) -> Graph:
    """A graph from tables: the first column of a vertex table is its id, the first two of an edge table its ends, unless named.

    generate_eid: every edge gets an `eid` of its own, equal parallel edges too."""
    vs = {x: df.withColumnRenamed(vid or df.columns[0], "id") for x, df in (vertices or {}).items()}
    es = {}
    for t, df in edges.items():
        out = df.withColumnsRenamed({src or df.columns[0]: "src", dst or df.columns[1]: "dst"})
        es[t] = out
    graph = Graph.from_edges(es, vs, directed)
    return graph.identified() if generate_eid else graph


def read_edgelist(spark: SparkSession, path: str, delimiter: str = " ", comment: str = "#") -> DataFrame:
    """`src, dst, w` from lines `src dst [weight]`; other lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    p = F.split(F.trim("value"), delimiter)
    return lines.select(F.get(p, F.lit(0)).try_cast("bigint").alias("src"), F.get(p, F.lit(1)).try_cast("bigint").alias("dst"), F.coalesce(F.get(p, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("w")).where("src is not null and dst is not null")


def write_edgelist(edges: DataFrame, path: str, delimiter: str = " ") -> None:
    edges.select(F.concat_ws(delimiter, "src", "dst", "w").alias("value")).write.mode("overwrite").text(path)


def read_adjlist(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """`src, dst, w` from lines `src dst dst ...`."""
    p = F.split(F.trim("value"), delimiter)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.get(p, F.lit(0)).try_cast("bigint").alias("src"), F.explode(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("d"))
    return rows.select("src", F.col("d").try_cast("bigint").alias("dst"), F.lit(1.0).alias("w")).where("dst is not null")


def write_adjlist(edges: DataFrame, path: str, delimiter: str = " ") -> None:
    """One line per source with its destinations in order."""
    near = edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    near.select(F.concat_ws(delimiter, F.col("src").cast("string"), F.col("near").cast("array<string>")).alias("value")).write.mode("overwrite").text(path)


def output(result: DataFrame, path: str, filetype: str = "csv") -> None:
    """A context's frame to files."""
    writer = result.write.mode("overwrite")
    (writer.option("header", True).csv if filetype == "csv" else getattr(writer, filetype))(path)
