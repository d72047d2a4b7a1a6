"""State tables merged with batches by key, as relational plans: the result is the new state, written elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POLICIES = ("overwrite", "prefer_new", "keep_old", "fill_null", "fill_empty", "fill_zero", "greatest", "least")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; the plan keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def keyed_merge(state: DataFrame, batch: DataFrame, keys: Sequence[str], policies: dict[str, str]) -> DataFrame:
    """Full outer merge. Each column's policy says which side holds where both have the key: overwrite (the batch),
    prefer_new (the batch unless null), keep_old, fill_null (old unless null), fill_empty (old unless null or blank), fill_zero (old unless null or 0),
    greatest, least. Keys must be unique on both sides; null keys are equal to each other."""
    unknown = {p for p in policies.values() if p not in POLICIES}
    if unknown:
        raise ValueError(f"no such policy: {sorted(unknown)}")
    columns = list(policies)
    old = state.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("o__"))
    new = batch.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("n__"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    both = old.join(new, on, "full")

    def value(c: str) -> Column:
        o, n, policy = F.col(f"o_{c}"), F.col(f"n_{c}"), policies[c]
        if policy == "overwrite":
            merged = n
        elif policy == "prefer_new":
            merged = F.coalesce(n, o)
        elif policy == "keep_old":
            merged = o
        elif policy == "fill_null":
            merged = F.coalesce(o, n)
        elif policy == "fill_empty":
            merged = F.coalesce(F.when(F.trim(o) != "", o), n)
        elif policy == "fill_zero":
            merged = F.coalesce(F.when(o != 0, o), n)
        else:
            merged = (F.greatest if policy == "greatest" else F.least)(o, n)
        return F.when(F.col("o__").isNull(), n).when(F.col("n__").isNull(), o).otherwise(merged).alias(c)

    return both.select(*[F.when(F.col("o__").isNull(), F.col(f"n_{k}")).otherwise(F.col(f"o_{k}")).alias(k) for k in keys], *[value(c) for c in columns])


def insert_ignore(state: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The batch rows that are truly new: the first of each key, if the state doesn't have the key. As in a unique
    index, a key with a null in it equals no other, so such rows are all new."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    whole = latest_per_key(batch.filter(~null), keys, order).join(state.select(*keys).distinct(), list(keys), "left_anti")
    return whole.select(*batch.columns).unionByName(batch.filter(null))


def close_missing(state: DataFrame, batch: DataFrame, group: str, key: str, closed: str, at: Column) -> DataFrame:
    """Sets ``closed`` on open rows that a batch with rows for their group doesn't have, and clears it on those it
    has; a group that the batch doesn't mention is left alone."""
    present = batch.filter(F.trim(F.col(key)) != "").select(group, key).distinct().withColumn("_seen", F.lit(True))
    groups = batch.select(group).distinct().withColumn("_polled", F.lit(True))
    joined = state.join(present, [group, key], "left").join(groups, group, "left")
    value = F.when(F.col("_seen"), F.lit(None)).when(F.col("_polled") & F.col(closed).isNull(), at).otherwise(F.col(closed))
    return joined.withColumn(closed, value.cast(state.schema[closed].dataType)).select(*state.columns)


def closed_over_snapshots(snapshots: DataFrame, group: str, key: str, on: str, closed: str) -> DataFrame:
    """group, key, ``closed`` of every key ever listed: the state that ``close_missing`` leaves when it is folded over all
    snapshots by date from the first, the new keys of each being added as open ones.

    A key is closed on its group's first snapshot after the last that lists it, and open if there is none. That is one
    look-up, whatever the number of dates. Rows without a date or key are in no snapshot.
    """
    listed = snapshots.filter((F.trim(F.col(key)) != "") & F.col(on).isNotNull()).select(group, key, on)
    last = listed.groupBy(group, key).agg(F.max(on).alias("_last"))
    polled = listed.filter(F.col(group).isNotNull()).select(group, F.col(on).alias("_last")).distinct()
    later = polled.withColumn(closed, F.lead("_last").over(Window.partitionBy(group).orderBy("_last")))
    return last.join(later, [group, "_last"], "left").select(group, key, closed)


def merge_patch(state: DataFrame, patches: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """Shallow right-wins merge of string maps by key. Several patches of a key are one, of each entry the last by
    ``order`` (without it, the greatest value) holding."""
    at = F.struct(F.col(order), F.col("_v")) if order else F.col("_v")
    entries = patches.select(key, *([order] if order else []), F.explode(column).alias("_k", "_v")).groupBy(key, "_k").agg(F.max_by("_v", at).alias("_v"))
    right = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_patch"))
    joined = state.join(right, key, "left")
    old, new = F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), F.coalesce("_patch", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return joined.withColumn(column, F.map_concat(kept, new)).select(*state.columns)


def with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """Adds the columns that only the other table has, as nulls of its types."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in df.columns])


def filled(column: Column, kind: str) -> Column:
    """Whether a value says anything: text not blank, array not empty, number not 0."""
    if kind == "string":
        return F.coalesce(F.trim(column) != "", F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return F.coalesce(column > 0, F.lit(False))
    return column.isNotNull()


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, n_rows, n_filled, filled_share: one pass over the table, then turned into rows."""
    kinds = dict(df.dtypes)
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(filled(F.col(c), kinds[c])).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_filled")) for c in columns])).alias("p")
    return totals.select(F.col("n").alias("n_rows"), pairs).select("p.field", "n_rows", "p.n_filled", F.round(F.col("p.n_filled") / F.greatest("n_rows", F.lit(1)), 6).alias("filled_share"))
