"""Amounts and head counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_amount(n: Column) -> Column:
    """$x.yM, $xK or $x; '' for null and 0."""
    millions = F.replace(F.concat(F.lit("$"), F.format_string("%.1f", n / 1_000_000), F.lit("M")), F.lit(".0M"), F.lit("M"))
    return F.when(n.isNull() | (n == 0), "").when(n >= 1_000_000, millions).when(n >= 1_000, F.concat(F.lit("$"), F.format_string("%.0f", n / 1_000), F.lit("K"))).otherwise(F.concat(F.lit("$"), F.format_string("%.0f", n)))


def parse_amount(text: Column) -> Column:
    """The digits of a text as a number; null for 'indefinite', 0 and no number."""
    n = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
    return F.when(~F.lower(text).contains("indefinite") & (n != 0), n)


def first_integer(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"\d[\d,]*", 0), ",", "").try_cast("bigint")


def digits_equal(a: Column, b: Column) -> Column:
    keep = lambda c: F.regexp_replace(c, "[^0-9.]", "")
    return keep(a) == keep(b)


def sanitize_head_count(value: Column, year: int, founded: Column | None = None, floor: int | None = None) -> Column:
    """Null where a head count is a calendar year in disguise: the founding year, or between ``floor`` (default last
    year) and next year; null and non-positive values are null too."""
    low = floor if floor is not None else year - 1
    leak = value.between(low, year + 1)
    if founded is not None:
        leak = leak | F.coalesce(value == founded, F.lit(False))
    return F.when((value > 0) & ~leak, value)


def round_head_count(n: Column) -> Column:
    """Steps of 10 below 100 (at least 10), of 50 below 1000, of 100 above; halves go to the even step."""
    step = lambda size: F.bround(n / size) * size
    return F.when(n <= 0, 0).when(n < 100, F.greatest(F.lit(10), step(10))).when(n < 1000, step(50)).otherwise(step(100)).cast("bigint")
