"""Queries of sampling, change feeds and further algorithms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import algorithms as al
from ..operators import flash, sampling
from ..session import read
from .graph import _E, _users

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _seeds(e: DataFrame) -> DataFrame:
    """Every vertex."""
    return al.ends(e)


_add("l_neighbor_topk", f"WITH {_E} SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5", lambda s, d: sampling.neighbors(_users(s, d), _seeds(_users(s, d)), 5, "topk"))
_add("l_neighbor_full", f"WITH {_E} SELECT src, dst FROM e", lambda s, d: sampling.neighbors(_users(s, d), _seeds(_users(s, d)), 5, "full"))
_add("l_neighbor_weight", None, lambda s, d: sampling.neighbors(_users(s, d), _seeds(_users(s, d)), 5, "edge_weight"))
_add("l_neighbor_in_degree", None, lambda s, d: sampling.neighbors(_users(s, d), _seeds(_users(s, d)), 5, "in_degree"))
_add("l_hops", None, lambda s, d: sampling.hops(_users(s, d), _seeds(_users(s, d)), [4, 2]))
_add("l_negative", None, lambda s, d: sampling.negatives(_users(s, d), _users(s, d).select(F.col("dst").alias("id")), 3))
for _s in ("edge_weight", "in_degree"):
    _add(
        f"l_{_s}_counts",
        f"WITH {_E} SELECT src, least(5, count(*)) AS n, least(5, count(*)) AS n_edges FROM e GROUP BY 1",
        lambda s, d, how=_s: _counted(sampling.neighbors(_users(s, d), _seeds(_users(s, d)), 5, how), _users(s, d)),
    )
_add("l_random_counts", f"WITH {_E} SELECT src, 5::BIGINT AS n FROM e GROUP BY 1", lambda s, d: sampling.neighbors(_users(s, d), _seeds(_users(s, d)), 5, "random").join(_users(s, d), ["src", "dst"], "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("n")))
_add("l_negative_counts", f"WITH {_E} SELECT src, least(3, (SELECT count(DISTINCT dst) FROM e) - count(DISTINCT dst) - max(CASE WHEN src IN (SELECT dst FROM e) THEN 1 ELSE 0 END)) AS n, 0::BIGINT AS n_edges FROM e GROUP BY 1", lambda s, d: _counted(sampling.negatives(_users(s, d), _users(s, d).select(F.col("dst").alias("id")), 3), _users(s, d)))
_add("u_upsert_batch", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", lambda s, d: streaming.latest(read(s, d, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value"))
_add(
    "u_merge",
    "WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 20 DAY FROM events) GROUP BY 1), b AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts < (SELECT min(ts) + INTERVAL 20 DAY FROM events) GROUP BY 1) SELECT coalesce(b.user_id, c.user_id) AS user_id, coalesce(c.v, b.v) AS value FROM b FULL JOIN c USING (user_id) WHERE coalesce(c.t, '') <> 'purchase'",
    lambda s, d: _merge(read(s, d, "events")),
)
_add(
    "u_merge_ops",
    """WITH c AS (SELECT user_id, ts, event_id, value, CASE event_type WHEN 'purchase' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS op FROM events),
    r AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE op <> 'UPDATE') AS reset, arg_max(op, (ts, event_id)) FILTER (WHERE op <> 'UPDATE') AS rop FROM c GROUP BY 1),
    l AS (SELECT c.user_id, any_value(rop) AS rop, count(*) FILTER (WHERE op = 'UPDATE') AS k, arg_max(value, (ts, event_id)) FILTER (WHERE op = 'INSERT' OR (op = 'UPDATE' AND value IS NOT NULL)) AS v FROM c JOIN r USING (user_id) WHERE reset IS NULL OR (ts, event_id) >= reset GROUP BY 1)
    SELECT user_id, v AS value FROM l WHERE k > 0 OR rop = 'INSERT'""",
    lambda s, d: _merge_all(read(s, d, "events")),
)
_add("u_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL", lambda s, d: streaming.windowed_counts(read(s, d, "events")))
_add("a_bridges", None, lambda s, d: flash.bridges(_users(s, d)))
_add("a_cut_points", None, lambda s, d: flash.cut_points(_users(s, d)))
_add("a_onion", None, lambda s, d: flash.onion_layers(_users(s, d)))


def _counted(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Different pairs of a source, and how many of them are edges."""
    real = edges.select("src", "dst", F.lit(1).alias("real"))
    return pairs.distinct().join(real, ["src", "dst"], "left").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("real").alias("n_edges"))


def _merge(events: DataFrame) -> DataFrame:
    """Users' last values up to day 20, with the events after as changes; a purchase deletes the user."""
    cut = events.agg(F.min("ts") + F.expr("INTERVAL 20 DAYS")).scalar()
    base = streaming.latest(events.where(F.col("ts") < cut).select("user_id", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "value")
    op = F.when(F.col("event_type") == "purchase", "DELETE").otherwise("UPDATE")
    return streaming.merge(base, events.where(F.col("ts") >= cut).select("user_id", "value", "ts", "event_id", op.alias("op")), ["user_id"], ["ts", "event_id"])


def _merge_all(events: DataFrame) -> DataFrame:
    """All events as changes of an empty table, many of one user: purchases delete, signups insert, others update."""
    op = F.when(F.col("event_type") == "purchase", "DELETE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE")
    changes = events.select("user_id", "value", "ts", "event_id", op.alias("op"))
    return streaming.merge(changes.select("user_id", "value").limit(0), changes, ["user_id"], ["ts", "event_id"])
