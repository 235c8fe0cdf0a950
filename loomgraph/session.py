"""Session helpers: table access and durable materialisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: dict[str, SparkSession] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The parquet table `table` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`). Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


def _kept(df: DataFrame, path: str) -> DataFrame:
    _paths[id(df)] = (df, path)
    return df


def materialize(df: DataFrame, by: str | None = None, replaces: DataFrame | list[DataFrame] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there and survives lost executors.

    `by`: the rows are bucketed by a column, in as many buckets as shuffles have partitions, so that joins and
    aggregates by it don't shuffle them again. `replaces`: frames made here that nothing needs any more; their files are
    deleted once the new ones are there.
    """
    return measured(df, {}, by, replaces)[0]


def measured(df: DataFrame, values: dict[str, Column], by: str | None = None, replaces: DataFrame | list[DataFrame] = ()) -> tuple[DataFrame, dict]:
    """Like `materialize`, with aggregates of the rows that are taken while they are written."""
    spark = df.sparkSession
    path = _new_path(spark)
    seen = Observation() if values else None
    out = df.observe(seen, *[c.alias(k) for k, c in values.items()]) if values else df
    if by is None:
        out.write.option("compression", "zstd").parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = "loomgraph_" + path.rpartition("/")[2]
        out.write.bucketBy(n, by).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
        back = spark.table(name)
    release(*([replaces] if isinstance(replaces, DataFrame) else replaces))
    return _kept(back, path), dict(seen.get) if values else {}


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """`df` written in buckets, each by one task."""
    return materialize(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by), by)


def release(*frames: DataFrame) -> None:
    """Deletes the files of frames made by `materialize`; nothing may read them afterwards."""
    for df in frames:
        found = _paths.pop(id(df), None)
        if found:
            spark = _written.pop(found[1])
            spark.sql(f"DROP TABLE IF EXISTS loomgraph_{found[1].rpartition('/')[2]}")
            _delete(spark, found[1])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are deleted when the query ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Grown:
    """A set of rows that grows by a layer per round: layers are written once and merged by eights, so that the plan that
    reads all of them stays short and every row is rewritten a logarithmic number of times."""

    def __init__(self, first: DataFrame) -> None:
        self.layers = [(0, first)]

    def add(self, layer: DataFrame) -> None:
        """Adds a materialised frame. The one added last stays as it is, as it may be the front of the next round."""
        while len(self.layers) >= 8 and len({size for size, _ in self.layers[-8:]}) == 1:
            last = self.layers[-8:]
            merged = materialize(_union([df for _, df in last]), replaces=[df for _, df in last])
            self.layers = [*self.layers[:-8], (last[0][0] + 1, merged)]
        self.layers.append((0, layer))

    def rows(self) -> DataFrame:
        return _union([df for _, df in self.layers])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
