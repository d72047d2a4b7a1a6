"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def centroid(df: DataFrame, by: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Element-wise mean per group: averages by position are combined in the map stage, so no group is gathered."""
    means = df.select(*by, F.posexplode(vector).alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias(name))


def blend(a: Column, b: Column, share: float = 0.7) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share))
