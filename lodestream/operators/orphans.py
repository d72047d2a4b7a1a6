"""References to records that do not exist: missing, deleted, or created only after the record that names them.

References are counted per table, key and period before any join, so a key that a third of all rows name is a few rows
of the join. The few keys that carry more than a fixed share of the references (there can be no more than 1 / share
of them) are checked by a broadcast join; all others by a shuffled anti-join; the orphan counts of both are united.
A period in which a target came into being is the only one whose records are looked at one by one; the list of orphan
records reads only the records of orphan keys and periods, by the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import staged

#: A key with more than this share of all references is heavy; at most 1 / HEAVY_SHARE keys can be.
HEAVY_SHARE = 0.001

# Texts that stand for "no reference".
PLACEHOLDERS = ("", "null", "none", "nil", "nan", "na", "n/a", "n.a.", "-", "--", "?", "undefined", "unknown", "tbd", "(none)", "<null>")


def reference_key(column: Column) -> Column:
    """The id's 32 hexadecimal digits in lower case; another text is kept as 'text:...', which no target has.

    Null, blank and placeholder texts are null.
    """
    plain = F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", ""))
    digits = F.regexp_extract(F.regexp_replace(plain, "[^0-9a-z]", ""), "([0-9a-f]{32})$", 1)
    return F.when(column.isNull() | plain.isin(*PLACEHOLDERS), None).when(digits != "", digits).otherwise(F.concat(F.lit("text:"), plain))


def references(records: DataFrame, table_name: str, record_id: str, reference: str, record_time: str) -> DataFrame:
    """table_name, record_id, key, at, period of every record that refers to something."""
    return records.select(
        F.lit(table_name).alias("table_name"),
        F.col(record_id).alias("record_id"),
        reference_key(F.col(reference)).alias("key"),
        F.col(record_time).alias("at"),
        F.date_format(F.col(record_time), "yyyy-MM").alias("period"),
    ).filter(F.col("key").isNotNull())


def _target_times(targets: DataFrame, target_id: str, created: str) -> DataFrame:
    """One row per target key with its first creation; null creation counts as created before everything."""
    return targets.select(reference_key(F.col(target_id)).alias("key"), F.coalesce(F.col(created), F.lit("0001-01-01").cast("timestamp")).alias("created")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("created").alias("created"))


def counted(refs: DataFrame) -> DataFrame:
    """table_name, key, period, n, first_at, last_at of the references, a period without time being ''."""
    period = F.coalesce("period", F.lit("")).alias("period")
    return refs.groupBy("table_name", "key", period).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _heavy_keys(counts: DataFrame) -> DataFrame:
    """Keys with more than HEAVY_SHARE of the references; the bound on their number makes them safe to broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > F.lit(max(1.0, HEAVY_SHARE * total))).select("key")


def orphan_periods(counts: DataFrame, targets: DataFrame, removed: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows of ``counted`` with an orphan, with ``state`` (missing, deleted or late) and ``created``, the time before
    which a record of a late target is an orphan."""
    found = _target_times(targets, "id", "created_at")
    gone = removed.select(reference_key(F.col("discovery_company_id")).alias("key")).filter(F.col("key").isNotNull()).distinct()

    def judged(some: DataFrame, present: DataFrame, log: DataFrame) -> DataFrame:
        absent = some.join(present, "key", "left_anti").join(log.withColumn("logged", F.lit(True)), "key", "left")
        kind = F.when(F.col("logged"), F.lit("deleted")).otherwise(F.lit("missing"))
        absent = absent.select(*some.columns, kind.alias("state"), F.lit(None).cast("timestamp").alias("created"))
        late = some.join(present, "key").filter(F.col("created") > F.col("first_at")).select(*some.columns, F.lit("late").alias("state"), "created")
        return absent.unionByName(late)

    # Heavy keys: the bounded side is the keys, so the target tables are cut down to them and broadcast.
    few = F.broadcast(heavy)
    of_heavy = judged(counts.join(few, "key", "left_semi"), F.broadcast(found.join(few, "key", "left_semi")), F.broadcast(gone.join(few, "key", "left_semi")))
    of_rest = judged(counts.join(few, "key", "left_anti"), found, gone)
    return of_heavy.unionByName(of_rest)


def _prepared(refs: DataFrame, targets: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records once each, heavy keys, orphan periods; all staged."""
    once = staged(refs.groupBy("table_name", "record_id", "key").agg(F.min("at").alias("at"), F.min("period").alias("period")), "references")
    counts = staged(counted(once), "reference-counts")
    heavy = staged(_heavy_keys(counts), "heavy-keys")
    return once, heavy, staged(orphan_periods(counts, targets, removed, heavy), "orphan-periods")


def _records_of(once: DataFrame, heavy: DataFrame, periods: DataFrame) -> DataFrame:
    """The records of the given keys and periods that are orphans."""
    few = F.broadcast(heavy)
    on = ["table_name", "key", "_period"]
    rows = once.withColumn("_period", F.coalesce("period", F.lit("")))
    states = periods.select("table_name", "key", F.col("period").alias("_period"), "state", "created")
    hot = rows.join(few, "key", "left_semi").join(F.broadcast(states.join(few, "key", "left_semi")), on)  # at most 1,000 keys x months
    cold = rows.join(few, "key", "left_anti").join(states.join(few, "key", "left_anti"), on)
    return hot.unionByName(cold).filter((F.col("state") != "late") | (F.col("created") > F.col("at")))


def orphan_records(refs: DataFrame, targets: DataFrame, removed: DataFrame) -> DataFrame:
    """table_name, record_id, orphan_kind, period: one row per orphan record.

    ``refs`` as from ``references``; ``targets`` has id and created_at; ``removed`` has discovery_company_id.
    Repeated rows of a record count once, with its earliest time. A record without a time can be missing or
    deleted, never late, and has a null period. Empty tables are allowed: without targets every reference is an
    orphan. An id that was removed and is there again is no orphan.
    """
    return _records_of(*_prepared(refs, targets, removed)).select("table_name", "record_id", F.col("state").alias("orphan_kind"), "period").distinct()


def orphan_report(refs: DataFrame, targets: DataFrame, removed: DataFrame) -> DataFrame:
    """Orphan records per table, period and kind: the counts of the periods, and of the records one by one only where a
    target came into being between the first and the last of a period's. A record that refers to two orphans of one
    kind counts for each."""
    once, heavy, periods = _prepared(refs, targets, removed)
    split = (F.col("state") == "late") & ~(F.col("created") > F.col("last_at"))
    whole = periods.filter(~split).select("table_name", F.when(F.col("period") != "", F.col("period")).alias("period"), F.col("state").alias("orphan_kind"), "n")
    parts = _records_of(once, heavy, periods.filter(split)).select("table_name", "period", F.col("state").alias("orphan_kind"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(parts).groupBy("table_name", "period", "orphan_kind").agg(F.sum("n").alias("n_orphans"))
