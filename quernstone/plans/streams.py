"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.streaming import receipts as st


def stream_hourly(spark, d):
    """Events by hour and type, counted by a stream."""
    w = st.drain(st.hourly(st.read_table(spark, d, "events")), "complete")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def stream_hourly_final(spark, d):
    """The hours that the watermark has passed: appended once, and then forgotten by the state."""
    w = st.drain(st.hourly(st.read_table(spark, d, "events")))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def stream_first_receipts(spark, d):
    """Distinct receipts of phase9_tune by method, replays dropped by a stream."""
    r = st.drain(st.first_receipts(st.read_table(spark, d, "phase9_tune").select("id", "method", "archive_sha256", "arrived_at")))
    return r.groupBy("method").agg(F.count("*").alias("n"))


def stream_best(spark, d):
    """The smallest archive of each method, kept as keyed state."""
    r = st.drain(st.best_per_method(st.read_table(spark, d, "phase9_tune")), "update")
    return r.groupBy("method").agg(F.min("best").alias("best"))


def queries() -> dict:
    return {f.__name__: f for f in (stream_hourly, stream_hourly_final, stream_first_receipts, stream_best)}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
        "stream_hourly_final": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
        "stream_first_receipts": "SELECT method, count(*) AS n FROM (SELECT id, archive_sha256, any_value(method) AS method FROM phase9_tune GROUP BY id, archive_sha256) GROUP BY method",
        "stream_best": "SELECT method, min(TRY_CAST(archive_bytes AS BIGINT)) AS best FROM phase9_tune WHERE attribution = 'search/tune' AND regexp_full_match(tune, '[0-9]+') AND TRY_CAST(tune AS BIGINT) BETWEEN 0 AND 255 AND regexp_full_match(archive_bytes, '[0-9]+') AND TRY_CAST(archive_bytes AS BIGINT) IS NOT NULL GROUP BY method",
    }
