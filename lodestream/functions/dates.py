"""Dates of feeds and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_event_date(text: Column) -> Column:
    """ISO with T (Z or offset; else UTC), RFC 2822, or a leading Y-m-d or Y/m/d; null otherwise. Session zone UTC."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(t))
    mail = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT)$", " +0000"), r"\s*\([^)]*\)$", "")
    rfc = F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")))
    day = F.left(t, F.lit(10))
    return F.coalesce(iso, rfc, F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), F.try_to_timestamp(day, F.lit("yyyy/MM/dd")))


def parse_notice_date(text: Column) -> Column:
    """m/d/Y, m/d/y, else as an event's date; a space-separated ISO time is read to the second."""
    t = F.left(F.trim(text), F.lit(10))
    american = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("M/d/yyyy"))).when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(t, F.lit("M/d/yy")))
    spaced = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} "), F.try_to_timestamp(F.left(F.trim(text), F.lit(19))))
    return F.coalesce(american, spaced, parse_event_date(text))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def older_than(ts: Column, as_of: Column, interval: str) -> Column:
    """Null, or before as_of less the interval."""
    return ts.isNull() | (ts < as_of - F.expr(f"INTERVAL {interval}"))


def retry_due(last: Column, attempts: Column, as_of: Column, most_doublings: int = 4) -> Column:
    """Whether the doubling delay (in minutes) since the last attempt is over; null has never been tried."""
    minutes = F.pow(F.lit(2.0), F.least(F.coalesce(attempts, F.lit(0)), F.lit(most_doublings)))
    return last.isNull() | (F.unix_micros(as_of) - F.unix_micros(last) > minutes * 60_000_000)
