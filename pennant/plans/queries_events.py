"""Queries over the events by their own time: what a stream over the whole table gives, and the same of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.streaming import events


def _table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _streamed(spark: SparkSession, d: str, what: Callable[[DataFrame], DataFrame]) -> DataFrame:
    # as a pattern, since the table may be one file
    return events.followed(spark, f"{d}/[e]vents.parquet", _table(spark, d).schema, what)


def _flat(result: DataFrame, key: str, bounds: str) -> DataFrame:
    return result.select(key, F.unix_micros(f"{bounds}.start").alias("start_us"), F.unix_micros(f"{bounds}.end").alias("end_us"), "events", "cents")


_HOUR = 3_600_000_000
_ONCE = "once AS (SELECT event_id, any_value(epoch_us(ts)) AS us, any_value(user_id) AS user_id, any_value(event_type) AS event_type, any_value(value) AS value FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL GROUP BY event_id)"
_SUMS = "count(*) AS events, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS cents"
_SESSIONS = f"""steps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {6 * _HOUR} THEN 0 ELSE 1 END AS fresh FROM once),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM steps),
result AS (SELECT user_id, min(us) AS start_us, max(us) + {6 * _HOUR} AS end_us, {_SUMS} FROM runs GROUP BY user_id, run)"""
_WINDOWS = f"""result AS (
  SELECT event_type, us // {6 * _HOUR} * {6 * _HOUR} - back * {6 * _HOUR} AS start_us, us // {6 * _HOUR} * {6 * _HOUR} - back * {6 * _HOUR} + {24 * _HOUR} AS end_us, {_SUMS}
  FROM once, range(4) b(back) GROUP BY event_type, start_us, end_us)"""
_CLOSED = f"WHERE end_us <= (SELECT max(us) // 1000 * 1000 FROM once) - {2 * _HOUR}"

EVENTS = {
    "st1_sessions": (lambda s, d: _flat(events.sessions(_table(s, d)), "user_id", "session"), f"WITH {_ONCE}, {_SESSIONS} SELECT * FROM result"),
    "st1_windows": (lambda s, d: _flat(events.windows(_table(s, d)), "event_type", "window"), f"WITH {_ONCE}, {_WINDOWS} SELECT * FROM result"),
    "st1_streamed_sessions": (lambda s, d: _flat(_streamed(s, d, events.sessions), "user_id", "session"), f"WITH {_ONCE}, {_SESSIONS} SELECT * FROM result {_CLOSED}"),
    "st1_streamed_windows": (lambda s, d: _flat(_streamed(s, d, events.windows), "event_type", "window"), f"WITH {_ONCE}, {_WINDOWS} SELECT * FROM result {_CLOSED}"),
}
