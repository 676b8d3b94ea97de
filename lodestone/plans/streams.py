"""Queries whose batch form equals what the streaming functions keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.session import table
from lodestone.streaming import ingest


def event_windows(spark, d):
    w = ingest.event_windows(table(spark, d, "events"), "1 hour")
    return w.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, d):
    s = ingest.sessions(table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions}

SQL = {
    "event_windows": """SELECT (epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "event_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM g GROUP BY 1""",
}
