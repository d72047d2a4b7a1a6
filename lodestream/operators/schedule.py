"""Which records are due: ranked per group, fairly across groups, within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.config import DEFAULTS


def ranked_within(df: DataFrame, group: str, order: list[Column], budget: int, name: str = "rank") -> DataFrame:
    """The first ``budget`` rows of each group; the window limit works before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= budget)


def fair_share(candidates: DataFrame, id_col: str, group: str, rank: str, cap: int) -> DataFrame:
    """Round robin over the groups by rank: an id that several groups want goes to the first in order of rank and
    group, and the first ``cap`` rows of that order are taken."""
    w = Window.partitionBy(id_col).orderBy(rank, group)
    once = candidates.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")
    return once.orderBy(rank, group, id_col).limit(cap)


def window_budget(calls: DataFrame, at: str, order: list[str], width: str, limit: int, headroom: float = DEFAULTS.headroom) -> DataFrame:
    """window_start, n_calls, n_admitted per tumbling window: the first int(limit x headroom) calls are admitted."""
    most = int(limit * headroom)
    return calls.groupBy(F.window(at, width)["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n_calls")).withColumn("n_admitted", F.least("n_calls", F.lit(most)))


def daily_cap(df: DataFrame, at: str, order: list[str], cap: int) -> DataFrame:
    w = Window.partitionBy("day").orderBy(*order)
    return df.withColumn("day", F.to_date(at)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def rolling_list(df: DataFrame, group: str, order: list[str], value: str, n: int = 5) -> DataFrame:
    """Adds ``last_sum`` and ``last_n`` over the row and the n - 1 before it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("last_sum", F.sum(value).over(w)).withColumn("last_n", F.count(F.lit(1)).over(w))
