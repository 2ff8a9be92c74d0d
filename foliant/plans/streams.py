"""Streaming forms run over the events table as far as it goes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.links import shared_dir
from ..sources.tables import table
from ..streaming import days


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    return days.session_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


def r4_stream_days(spark, d):
    out = _folder(spark)
    # a log of the totals that a batch has changed; closed days leave the state
    days.changes(days.day_totals(_events(spark, d), "user_id", "value"), f"{out}/totals", f"{out}/checkpoint")
    return days.latest(spark, f"{out}/totals", ["user_id", "day"], "sessions")


def r8_stream_sessions(spark, d):
    """Stretches of a reader's events with no gap of three hours; those that the watermark has closed."""
    out = _folder(spark)
    found = days.session_windows(_events(spark, d), "user_id", "3 hours", late="0 seconds")
    days.to_table(found, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def r2_stream_upserts(spark, d):
    out = _folder(spark)
    days.upserts(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", f"{out}/log", f"{out}/checkpoint")
    return days.latest(spark, f"{out}/log", ["user_id"], "event_id")


def r6_stream_distinct(spark, d):
    out = _folder(spark)
    days.to_table(days.deduplicated(_events(spark, d), ["user_id", "event_type"], late="60 days").select("user_id", "event_type"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows")


QUERIES = {f.__name__: f for f in (r4_stream_days, r8_stream_sessions, r2_stream_upserts, r6_stream_distinct)}

ORACLE_SQL = {
    "r4_stream_days": "SELECT user_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, round(sum(value), 6) AS total, count(*) AS sessions FROM events GROUP BY 1, 2",
    "r8_stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 3 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e), x AS (SELECT user_id, n, max(ts) AS last, count(*) AS events FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events FROM x WHERE last + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1""",
    "r2_stream_upserts": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "r6_stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
}
