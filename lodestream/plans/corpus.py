"""Queries of the general training-data problems (p1, p2, p3, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import event_features, instants, orphans, snapshot_delta, units
from lodestream.runtime import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_delta.snapshot_changes(load(spark, sf_dir, "job_post_snapshot"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_features.event_counts(load(spark, sf_dir, "signal_event"))


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_features.entity_features(load(spark, sf_dir, "signal_event"), as_of="2025-06-30")


def p2_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features in long form, a row for each company and type."""
    rows = event_features.window_features(event_features.cumulative_store(load(spark, sf_dir, "signal_event")), "2025-03-31", (7, 30, 90))
    return rows.select("company_id", "event_type", "n_events", "n_events_7d", "n_events_30d", "n_events_90d", F.round("total_confidence", 4).alias("total_confidence"), F.round("total_confidence_30d", 4).alias("total_confidence_30d"), F.datediff(F.lit("2025-03-31").cast("date"), F.to_date("last_observed_at")).alias("days_since_last"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    watch = orphans.references(load(spark, sf_dir, "company"), "company", "id", "discovery_company_id", "created_at")
    posts = orphans.references(load(spark, sf_dir, "discovery_job_post"), "discovery_job_post", "id", "company_id", "first_seen_at")
    return watch.unionByName(posts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_records(_references(spark, sf_dir), load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "removed_company"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, sf_dir), load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "removed_company"))


def p5_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.solved_quantities(load(spark, sf_dir, "company_signal_result"), load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "currency_rate"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.converted_quantities(p5_solved(spark, sf_dir)).select("table_name", "record_id", "field_name", "low_value", "high_value").distinct()


def p5_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.inferred_units(load(spark, sf_dir, "company_signal_result"), load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "currency_rate"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.draft_instants(load(spark, sf_dir, "signal_event_draft"), load(spark, sf_dir, "feed"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_features, p2_windows, p3_found, p3_report, p5_found, p5_solved, p5_inferred, p6_found)}


ORACLES = {
    "p1_found": r"""
WITH posts AS (
  SELECT snapshot_on, company_id, lower(trim(external_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS external_id,
         trim(regexp_replace(lower(nfc_normalize(title)), '[\s\x{00a0}]+', ' ', 'g')) AS title,
         trim(regexp_replace(lower(nfc_normalize(location)), '[\s\x{00a0}]+', ' ', 'g')) AS location,
         epoch_us(first_seen_at) // 1000000 AS seen,
         row_number() OVER (PARTITION BY snapshot_on, company_id, lower(trim(external_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))
                            ORDER BY delivered_at DESC NULLS LAST, first_seen_at DESC NULLS LAST, title DESC NULLS LAST, location DESC NULLS LAST) AS rn
  FROM job_post_snapshot WHERE snapshot_on IS NOT NULL
), v AS (SELECT * FROM posts WHERE rn = 1 AND length(external_id) > 0),
dates AS (SELECT snapshot_on, lag(snapshot_on) OVER (ORDER BY snapshot_on) AS before_on FROM (SELECT DISTINCT snapshot_on FROM v)),
cur AS (SELECT d.snapshot_on AS on_, v.* FROM v JOIN dates d ON v.snapshot_on = d.snapshot_on WHERE d.before_on IS NOT NULL),
prev AS (SELECT d.snapshot_on AS on_, v.* FROM v JOIN dates d ON v.snapshot_on = d.before_on)
SELECT strftime(coalesce(c.on_, p.on_), '%Y-%m-%d') AS snapshot_on, coalesce(c.company_id, p.company_id) AS company_id,
       coalesce(c.external_id, p.external_id) AS external_id,
       CASE WHEN p.external_id IS NULL THEN 'added' WHEN c.external_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON c.on_ = p.on_ AND c.company_id IS NOT DISTINCT FROM p.company_id AND c.external_id = p.external_id
WHERE p.external_id IS NULL OR c.external_id IS NULL OR c.title IS DISTINCT FROM p.title
   OR c.location IS DISTINCT FROM p.location OR c.seen IS DISTINCT FROM p.seen
""",
    "p2_found": r"""
SELECT company_id, event_type, CAST(count(*) AS BIGINT) AS n_events FROM (
  SELECT min(company_id) AS company_id, min(kind) AS event_type FROM (
    SELECT dedupe_key, company_id, regexp_replace(trim(lower(event_type)), '[ _-]+', '_', 'g') AS kind
    FROM signal_event WHERE trim(event_type) <> '') GROUP BY dedupe_key)
GROUP BY company_id, event_type
""",
    "p2_windows": r"""
WITH e AS (
  SELECT company_id, event_type, CAST(seen AT TIME ZONE 'UTC' AS DATE) AS day, coalesce(c, 0) AS c FROM (
    SELECT dedupe_key, min(company_id) AS company_id, min(kind) AS event_type, min(observed_at) AS seen, max(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END) AS c FROM (
      SELECT dedupe_key, company_id, regexp_replace(trim(lower(event_type)), '[ _-]+', '_', 'g') AS kind, observed_at, confidence FROM signal_event WHERE trim(event_type) <> '') GROUP BY dedupe_key)
  WHERE CAST(seen AT TIME ZONE 'UTC' AS DATE) <= DATE '2025-03-31')
SELECT company_id, event_type, count(*) AS n_events, count(*) FILTER (day > DATE '2025-03-24') AS n_events_7d, count(*) FILTER (day > DATE '2025-03-01') AS n_events_30d,
       count(*) FILTER (day > DATE '2024-12-31') AS n_events_90d, round(sum(c), 4) AS total_confidence, round(coalesce(sum(c) FILTER (day > DATE '2025-03-01'), 0), 4) AS total_confidence_30d,
       CAST(DATE '2025-03-31' - max(day) AS INTEGER) AS days_since_last
FROM e GROUP BY 1, 2
""",
    "p3_found": r"""
WITH refs AS (
  SELECT 'company' AS table_name, id AS record_id, discovery_company_id AS ref, created_at AS made FROM company
  UNION ALL SELECT 'discovery_job_post', id, company_id, first_seen_at FROM discovery_job_post),
named AS (SELECT table_name, record_id, right(regexp_replace(lower(ref), '[^0-9a-z]', '', 'g'), 32) AS k, made,
                 strftime(made AT TIME ZONE 'UTC', '%Y-%m') AS period
          FROM refs WHERE trim(ref) NOT IN ('', 'n/a', 'null', 'None', '-')),
target AS (SELECT replace(id, '-', '') AS k, min(created_at) AS created FROM discovery_company GROUP BY 1),
gone AS (SELECT DISTINCT replace(discovery_company_id, '-', '') AS k FROM removed_company)
SELECT DISTINCT table_name, record_id,
       CASE WHEN t.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind, period
FROM named n LEFT JOIN target t ON n.k = t.k LEFT JOIN gone g ON n.k = g.k
WHERE t.k IS NULL OR t.created > n.made
""",
}
ORACLES["p3_report"] = f"""
SELECT table_name, period, orphan_kind, CAST(count(*) AS BIGINT) AS n_orphans FROM ({ORACLES['p3_found']}) GROUP BY ALL
"""
