"""Per-key results over very unequal keys.

Every aggregate here is algebraic, so each map task folds its rows into one state per key it meets (a hash table
that falls back to sorted spills when it outgrows memory) and only those states are shuffled. A key that holds a
third of all rows therefore reaches its reducer as at most one state per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_totals(df: DataFrame, key: str, counterpart: str) -> DataFrame:
    """Rows and distinct non-null counterparts per key: `key_value, n_rows, n_counterparts`.

    Distinct counting goes through (key, counterpart) states first: the pairs of a hot key are spread over all
    reducers, and the second fold again combines before it shuffles. A null key is a key of its own; null
    counterparts count as rows but not as counterparts; repeated rows count as often as they were delivered; an empty
    table gives no rows. Other columns of `df`, whatever their names, are not read.
    """
    pairs = df.select(F.col(key).cast("long").alias("key_value"), F.col(counterpart).alias("other"))
    pairs = pairs.groupBy("key_value", "other").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("key_value").agg(
        F.sum("n").alias("n_rows"), F.count("other").alias("n_counterparts")
    )


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, nulls included: `key_value, n_rows`."""
    return df.select(F.col(key).cast("long").alias("key_value")).groupBy("key_value").agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(df: DataFrame, key: str, share: tuple[int, int] = (1, 50)) -> DataFrame:
    """The non-null keys that hold at least `share` (a fraction, exact) of all rows of `df`: `key_value, n_rows`.

    Null keys and repeated rows count in the total. An empty table has no heavy keys.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top, bottom = share
    return key_counts(df, key).where(
        F.col("key_value").isNotNull() & (F.col("n_rows") * bottom >= total.scalar() * top)
    )


def named(df: DataFrame, table: str, column: str) -> DataFrame:
    """`df` with the table and column it is about, for unions over several keys."""
    rest: list[Column] = [F.col(c) for c in df.columns]
    return df.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), *rest)
