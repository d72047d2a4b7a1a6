"""Streaming queries, run with availableNow over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.streaming import jobs


def stream_distinct_events(spark, sf_dir) -> DataFrame:
    s = jobs.read_stream(spark, sf_dir, "signal_event").select("dedupe_key", "company_id", "observed_at")
    return jobs.run_available(jobs.distinct_events(s, "observed_at", ["dedupe_key"], "1000 days"), "distinct").select("dedupe_key", "company_id")


def stream_window_budget(spark, sf_dir) -> DataFrame:
    s = jobs.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_available(jobs.window_counts(s, "ts", "1 hour", 15, "1000 days"), "budget", "update")
    return out.groupBy("window_start").agg(F.max("n_calls").alias("n_calls"), F.max("n_admitted").alias("n_admitted"))


def stream_hiring_surges(spark, sf_dir) -> DataFrame:
    s = jobs.read_stream(spark, sf_dir, "company_signal_result").select("company_id", "captured_at", F.col("hiring_count").cast("long").alias("hiring_count"))
    return jobs.run_available(jobs.snapshot_changes(s, "company_id", "captured_at", "hiring_count"), "surges")


QUERIES = {f.__name__: f for f in (stream_distinct_events, stream_window_budget, stream_hiring_surges)}
ORACLES = {
    "stream_distinct_events": "SELECT DISTINCT dedupe_key, company_id FROM signal_event",
    "stream_window_budget": "SELECT date_trunc('hour', ts) AT TIME ZONE 'UTC' AS window_start, count(*) AS n_calls, least(count(*), 13) AS n_admitted FROM events GROUP BY 1",
    "stream_hiring_surges": """
WITH r AS (SELECT DISTINCT id, company_id, captured_at, coalesce(hiring_count, 0) AS n FROM company_signal_result),
p AS (SELECT *, lag(n) OVER (PARTITION BY company_id ORDER BY captured_at, id) AS before_ FROM r)
SELECT company_id, captured_at, CAST(before_ AS BIGINT) AS prev_count, CAST(n AS BIGINT) AS curr_count FROM p WHERE before_ > 0 AND n >= before_ * 1.5
""",
}
