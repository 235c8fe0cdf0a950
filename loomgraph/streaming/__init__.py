"""Change feeds: upserts into versioned tables, by Structured Streaming, and windowed counts over late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of every key, by an aggregate that combines before it shuffles."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def merge(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """`base` after INSERT, UPDATE, DELETE and CLEAR_PROPERTY changes, applied to each key in their order.

    UPDATE leaves properties that are null in the change as they were (and inserts a row that isn't there), INSERT
    replaces the row, CLEAR_PROPERTY makes the properties null that are set in the change. Deleting or clearing what isn't
    there does nothing. The result doesn't depend on how changes are cut into batches. Two changes of one key with equal
    `order` have no order; one of them comes first.

    What is left of a key is decided by aggregates that combine before they shuffle, so a key with a third of all changes
    is no burden: where its last INSERT or DELETE is, and for each property the last change after it that touches it.
    """
    values = [c for c in base.columns if c not in keys]
    at = F.struct(*order)
    reset = F.col(op).isin("INSERT", "DELETE")
    first = changes.groupBy(*keys).agg(F.max(F.when(reset, F.struct(at.alias("at"), F.col(op).alias("op")))).alias("_reset"))
    named = changes.select(*keys, F.col(op).alias("_op"), at.alias("_at"), *[F.col(c).alias(f"_n_{c}") for c in values])
    live = named.join(first, keys).where(F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset.at")))
    touched = [F.max(F.when((F.col("_op") == "INSERT") | (F.col("_op").isin("UPDATE", "CLEAR_PROPERTY") & F.col(f"_n_{c}").isNotNull()), F.struct("_at", "_op", F.col(f"_n_{c}").alias("v")))).alias(f"_t_{c}") for c in values]
    # clears of a row that isn't there do nothing: an UPDATE must have made it again before
    made = F.min(F.when(F.col("_op") == "UPDATE", F.col("_at"))).alias("_made")
    last = live.groupBy(*keys).agg(F.first("_reset").alias("_reset"), made, *touched)
    both = base.withColumn("_was", F.lit(True)).join(last, keys, "full")
    kept_base = F.col("_was").isNotNull() & F.col("_reset").isNull()
    exists = kept_base | (F.col("_reset.op") == "INSERT") | F.col("_made").isNotNull()
    out = []
    for c in values:
        t = F.col(f"_t_{c}")
        new = F.when(t["_op"] != "CLEAR_PROPERTY", t["v"])
        out.append(F.when(t.isNotNull(), new).when(kept_base, F.col(c)).alias(c))
    return both.where(F.coalesce(exists, F.lit(False))).select(*keys, *out)


class VersionedTable:
    """Snapshots of a table under one path, one folder per version; readers see the last version whose write ended."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
        done = [x for x in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName()[2:]) for x in done)

    def read(self, version: int | None = None) -> DataFrame:
        found = [v for v in self.versions() if version is None or v <= version]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame, version: int, keys: list[str], order: list[str]) -> None:
        """Writes the next version; a batch that is replayed overwrites its own."""
        merge(self.read(version - 1), changes, keys, order).write.mode("overwrite").parquet(f"{self.path}/v={version}")


def upsert_stream(changes: DataFrame, table: VersionedTable, keys: list[str], order: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a streaming change feed; the version is the batch id, so replays after a failure are harmless."""
    writer = changes.writeStream.foreachBatch(lambda df, batch: table.apply(df, batch, keys, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window, for streams too: rows later than the watermark are dropped there."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )
