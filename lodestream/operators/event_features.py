"""One row per entity with counts, recency and totals for each of hundreds of event types.

The store is a table of cumulative counts and totals by entity, type and day. A window feature is the difference
of two as-of look-ups in it (the last day not after the window's end, less the last day before its start), so
that any set of windows is served by the same table without another pass over the events.

Scale: redeliveries are removed by one shuffle on the event's own key, where no key is hot; the daily table is
pre-aggregated on (entity, type, day) before the cumulative window partitions it by (entity, type), so that the
largest group is the number of days in the data and not the number of events of a hot entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def event_type_key(column: Column) -> Column:
    """Types are the same whatever their case, outer blanks and word separator; blank is null."""
    squeezed = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")), r"[\s _-]+", "_")
    return F.when(F.length(squeezed) > 0, squeezed)


def confidence_share(column: Column) -> Column:
    """Confidence on the scale 0 to 1; some feeds give per cent."""
    return F.when(column > 1, column / 100).otherwise(column)


def distinct_events(events: DataFrame) -> DataFrame:
    """One row per dedupe_key: company_id, event_type, observed_at (the earliest delivery's), confidence.

    Rows without a usable event_type don't count. A row without dedupe_key is an event of its own by its id.
    Redeliveries that disagree give the least company and type, the earliest time and the greatest confidence.
    """
    typed = events.select(
        F.coalesce("dedupe_key", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("dedupe_key"),
        "company_id",
        event_type_key(F.col("event_type")).alias("event_type"),
        "observed_at",
        confidence_share(F.col("confidence")).alias("confidence"),
    ).filter(F.col("event_type").isNotNull() & F.col("company_id").isNotNull())
    return (
        typed.groupBy("dedupe_key")
        .agg(F.min(F.struct("company_id", "event_type")).alias("what"), F.min("observed_at").alias("observed_at"), F.max("confidence").alias("confidence"))
        .select("what.company_id", "what.event_type", "observed_at", "confidence")
    )


def cumulative_store(events: DataFrame) -> DataFrame:
    """company_id, event_type, day, cum_events, cum_confidence, last_observed_at: state at the end of each day.

    A null observed_at belongs to the day before all others, so that its event counts in totals only.
    """
    daily = (
        distinct_events(events)
        .groupBy("company_id", "event_type", F.coalesce(F.to_date("observed_at"), F.lit("0001-01-01").cast("date")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c"), F.max("observed_at").alias("m"))
    )
    upto = Window.partitionBy("company_id", "event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("company_id", "event_type", "day", F.sum("n").over(upto).alias("cum_events"), F.sum("c").over(upto).alias("cum_confidence"), F.max("m").over(upto).alias("last_observed_at"))


def window_features(store: DataFrame, as_of: str | None, days: Sequence[int]) -> DataFrame:
    """Per (company_id, event_type): totals up to ``as_of`` (null: all) and, for each d, those of the last d days.

    Each endpoint is one as-of look-up, done for all endpoints in a single aggregate: the value at the greatest
    day that is not after the endpoint.
    """
    end = F.lit(as_of).cast("date") if as_of else F.lit("9999-12-31").cast("date")

    def at(limit: Column, value: str) -> Column:
        return F.max_by(value, F.when(F.col("day") <= limit, F.col("day")))

    columns = [
        F.coalesce(at(end, "cum_events"), F.lit(0)).cast("long").alias("n_events"),
        F.coalesce(at(end, "cum_confidence"), F.lit(0.0)).alias("total_confidence"),
        at(end, "last_observed_at").alias("last_observed_at"),
    ]
    for d in days:
        start = F.date_sub(end, d)
        columns.append((F.coalesce(at(end, "cum_events"), F.lit(0)) - F.coalesce(at(start, "cum_events"), F.lit(0))).cast("long").alias(f"n_events_{d}d"))
        columns.append((F.coalesce(at(end, "cum_confidence"), F.lit(0.0)) - F.coalesce(at(start, "cum_confidence"), F.lit(0.0))).alias(f"total_confidence_{d}d"))
    return store.groupBy("company_id", "event_type").agg(*columns).filter(F.col("n_events") > 0)


def event_counts(events: DataFrame) -> DataFrame:
    """company_id, event_type, n_events over the whole table: the cumulative store at its last endpoint."""
    return window_features(cumulative_store(events), None, ()).select("company_id", "event_type", "n_events")


def entity_features(events: DataFrame, as_of: str, days: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """One row per company_id; ``features`` maps each event_type that occurs to its counts, recency and totals.

    Input: company_id, event_type, observed_at, confidence, dedupe_key, id; other columns are ignored. Events
    after ``as_of`` (a date) don't count. Null confidence adds nothing to a total; a null observed_at gives no
    recency. Types are sorted by name, so the row is deterministic. An empty table gives no row.
    """
    rows = window_features(cumulative_store(events), as_of, days)
    values = [
        "n_events",
        F.round("total_confidence", 6).alias("total_confidence"),
        F.datediff(F.lit(as_of).cast("date"), F.to_date("last_observed_at")).alias("days_since_last"),
    ]
    for d in days:
        values += [f"n_events_{d}d", F.round(f"total_confidence_{d}d", 6).alias(f"total_confidence_{d}d")]
    packed = rows.select("company_id", "n_events", F.struct("event_type", F.struct(*values).alias("v")).alias("e"))
    return packed.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_types"),
        F.sum("n_events").alias("n_events"),
        F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("features"),
    )
