"""Point-in-time snapshots of companies compared with the ones before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.config import DEFAULTS
from lodestream.functions import text


def with_previous(snapshots: DataFrame, key: str, at: str, columns: list[str], ties: list[str]) -> DataFrame:
    """Adds ``prev``, the struct of the columns in the preceding snapshot of the key."""
    w = Window.partitionBy(key).orderBy(at, *ties)
    return snapshots.withColumn("prev", F.lag(F.struct(*columns)).over(w))


def surges(paired: DataFrame, key: str, at: str, count: str, ratio: float = DEFAULTS.surge_ratio) -> DataFrame:
    """Snapshots whose count is at least ``ratio`` times the one before: key, at, prev_count, count, percent."""
    p, c = F.coalesce(F.col(f"prev.{count}"), F.lit(0)), F.coalesce(F.col(count), F.lit(0))
    return paired.filter((p > 0) & (c >= p * ratio)).select(key, at, p.cast("bigint").alias("prev_count"), c.cast("bigint").alias("curr_count"), F.round((c - p) / p * 100, 0).cast("bigint").alias("percent"))


def set_changes(paired: DataFrame, key: str, at: str, column: str, transform=lambda x: x) -> DataFrame:
    """key, at, item, change (first_seen or dropped) between the arrays of consecutive snapshots; a first snapshot
    changes nothing."""
    clean = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), transform))
    prev, curr = clean(F.col(f"prev.{column}")), clean(F.col(column))
    rows = paired.filter(F.col("prev").isNotNull()).select(key, at, F.array_except(curr, prev).alias("added"), F.array_except(prev, curr).alias("lost"))
    both = F.concat(F.transform("added", lambda x: F.struct(x.alias("item"), F.lit("first_seen").alias("change"))), F.transform("lost", lambda x: F.struct(x.alias("item"), F.lit("dropped").alias("change"))))
    return rows.select(key, at, F.explode(both).alias("c")).select(key, at, "c.item", "c.change")


def role_families_first_seen(paired: DataFrame, key: str, at: str, column: str) -> DataFrame:
    return set_changes(paired, key, at, column, text.role_family).filter(F.col("change") == "first_seen").select(key, at, F.col("item").alias("role_family"))


def spikes(posts: DataFrame, group: str, family: Column, least: int = DEFAULTS.spike_posts) -> DataFrame:
    """Open posts per company and role family where there are at least ``least``."""
    return posts.filter(F.col("closed_at").isNull()).groupBy(group, family.alias("role_family")).agg(F.count(F.lit(1)).alias("open_posts")).filter((F.col("open_posts") >= least) & F.col("role_family").isNotNull())


def concept_spikes(posts: DataFrame, group: str, as_of: Column, days: int = DEFAULTS.concept_days, least: int = DEFAULTS.concept_posts) -> DataFrame:
    recent = posts.filter(F.col("closed_at").isNull() & (F.col("first_seen_at") > as_of - F.make_dt_interval(F.lit(days))))
    return recent.select(group, F.explode("concepts").alias("c")).groupBy(group, F.lower("c").alias("concept")).agg(F.count(F.lit(1)).alias("n_posts")).filter(F.col("n_posts") >= least)


def concepts_first_seen(posts: DataFrame, group: str, as_of: Column, days: int = DEFAULTS.first_seen_days) -> DataFrame:
    """Concepts of open posts of the last days that no older post of the company has; a null concept among the
    older ones makes every comparison unknown, so that the company has none."""
    edge = as_of - F.make_dt_interval(F.lit(days))
    each = posts.select(group, "first_seen_at", "closed_at", F.explode("concepts").alias("c")).withColumn("concept", F.lower("c"))
    old = each.filter(F.col("first_seen_at") < edge)
    tainted = old.filter(F.col("concept").isNull()).select(group).distinct()
    new = each.filter((F.col("first_seen_at") > edge) & F.col("closed_at").isNull()).select(group, "concept").distinct()
    return new.join(old.select(group, "concept").distinct(), [group, "concept"], "left_anti").join(tainted, group, "left_anti").filter(F.col("concept").isNotNull())


def growth_events(now: DataFrame, before: DataFrame, group: str, item: str, count: str, least: int, ratio: float, strictly_more: bool = False) -> DataFrame:
    """group, item, event, prev_count, curr_count: first_seen where there was none before, spike where there are at least
    ``least`` and ``ratio`` times as many as before (or just more)."""
    joined = now.join(before.select(group, item, F.col(count).alias("prev_count")), [group, item], "left").withColumnRenamed(count, "curr_count")
    grown = F.col("curr_count") > F.col("prev_count") if strictly_more else F.col("curr_count") >= F.col("prev_count") * ratio
    event = F.when(F.col("prev_count").isNull(), "first_seen").when((F.col("curr_count") >= least) & grown, "spike")
    return joined.withColumn("event", event).filter(F.col("event").isNotNull()).select(group, item, "event", "prev_count", "curr_count")


def profile_changes(paired: DataFrame, key: str, at: str, ratio: float = 1.2) -> DataFrame:
    """key, at, change, before, after: a new funding stage; a head count that grew to ``ratio`` times the one before."""
    stage = (F.coalesce("funding_stage", F.lit("")) != "") & ~F.col("funding_stage").eqNullSafe(F.col("prev.funding_stage"))
    heads = (F.col("prev.headcount") > 0) & (F.col("headcount") >= F.col("prev.headcount") * ratio)
    found = F.array(
        F.when(stage, F.struct(F.lit("funding_round").alias("change"), F.col("prev.funding_stage").alias("before"), F.col("funding_stage").alias("after"))),
        F.when(heads, F.struct(F.lit("headcount_jump").alias("change"), F.col("prev.headcount").cast("string").alias("before"), F.col("headcount").cast("string").alias("after"))),
    )
    return paired.filter(F.col("prev").isNotNull()).select(key, at, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select(key, at, "c.*")
