"""Values at and beyond the bounds that operators once had: years, differences, periods, readings."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import instants, orphans, snapshot_delta, units

NY = ZoneInfo("America/New_York")


def us(moment):
    d = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


@pytest.mark.parametrize("y, mo, d, h", [(1850, 6, 1, 12), (1883, 11, 18, 12), (1899, 12, 31, 23), (1900, 1, 1, 0), (1918, 7, 1, 12), (2200, 12, 31, 23), (2300, 1, 1, 10), (2301, 7, 4, 10), (9998, 7, 1, 0)])
def test_local_times_of_any_year(spark, y, mo, d, h):
    df = spark.createDataFrame([(f"{y}-{mo:02d}-{d:02d} {h:02d}:00:00", "America/New_York", False)], "text string, tz string, day_first boolean")
    assert instants.to_instants(df).first()["epoch_us"] == us(datetime(y, mo, d, h, tzinfo=NY))


def test_first_and_last_years(spark):
    texts = ["0001-01-01", "9999-12-31 23:59", "0000-01-01", "1850-06-01T12:00:00Z"]
    df = spark.createDataFrame([(i, t, "UTC", False) for i, t in enumerate(texts)], "i int, text string, tz string, day_first boolean")
    got = {r["i"]: r["epoch_us"] for r in instants.to_instants(df, keep=["i"]).collect()}
    utc = timezone.utc
    assert got == {0: us(datetime(1, 1, 1, tzinfo=utc)), 1: us(datetime(9999, 12, 31, 23, 59, tzinfo=utc)), 2: None, 3: us(datetime(1850, 6, 1, 12, tzinfo=utc))}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 400), st.integers(0, 3), max_size=300), st.dictionaries(st.integers(0, 400), st.integers(0, 3), max_size=300), st.sampled_from([3, 24, 96]))
def test_differences_of_any_size(old, new, cells):
    arrays = lambda d: (np.array(list(d), np.int64), np.array(list(d.values()), np.int64))
    want = {(k, "added") for k in new.keys() - old.keys()} | {(k, "removed") for k in old.keys() - new.keys()} | {(k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    assert set(snapshot_delta.differences(arrays(old), arrays(new), cells)) == want


def test_differences_when_tables_never_peel(monkeypatch):
    monkeypatch.setattr(snapshot_delta, "peel", lambda cells, n: (None, 1))
    old, new = (np.arange(50), np.zeros(50, np.int64)), (np.arange(10, 60), np.ones(50, np.int64))
    got = dict(snapshot_delta.differences(old, new))
    assert sorted(got.values()) == ["added"] * 10 + ["changed"] * 40 + ["removed"] * 10


def test_orphans_are_counted_per_period_as_they_are_listed(spark):
    t = lambda m, d: datetime(2025, m, d)
    ids = [f"{i:032x}" for i in range(4)]
    refs = [("company", "r1", ids[0], t(1, 5)), ("company", "r2", ids[0], t(2, 5)), ("company", "r3", ids[0], t(2, 20)), ("company", "r4", ids[1], None), ("company", "r5", ids[2], t(1, 1)), ("company", "r5", ids[2], t(1, 3)), ("post", "r1", ids[0], t(3, 1)), ("company", "r6", ids[3], t(1, 1))]
    rows = spark.createDataFrame(refs, "table_name string, record_id string, key string, at timestamp").withColumn("period", F.date_format("at", "yyyy-MM"))
    targets = spark.createDataFrame([(ids[0], t(2, 10)), (ids[3], t(1, 1))], "id string, created_at timestamp")
    removed = spark.createDataFrame([(ids[2].upper(),)], "discovery_company_id string")
    listed = {tuple(r) for r in orphans.orphan_records(rows, targets, removed).collect()}
    assert listed == {("company", "r1", "late", "2025-01"), ("company", "r2", "late", "2025-02"), ("company", "r4", "missing", None), ("company", "r5", "deleted", "2025-01")}
    counted = {tuple(r) for r in orphans.orphan_report(rows, targets, removed).collect()}
    assert counted == {("company", "2025-01", "late", 1), ("company", "2025-02", "late", 1), ("company", None, "missing", 1), ("company", "2025-01", "deleted", 1)}
    assert orphans.orphan_report(rows.limit(0), targets, removed).count() == 0


def test_identities_decide_where_parsing_cannot(spark):
    """A dot before three digits, with and without a scale; a number without any unit; head counts by the column."""
    schema = "id string, company_id string, total_raised string, amount_unit string"
    r = spark.createDataFrame([("a", "c", "1.250 million USD", None), ("b", "c", "$1.3M", None), ("d", "e", "1.250 million USD", None), ("f", "e", "$1.2bn", None), ("g", "h", "1.250 million USD", None), ("i", "c", "1.2", "EUR m")], schema)
    c = spark.createDataFrame([("c", None, "1.200 people", 1250), ("e", None, "1.200 people", 1), ("h", None, "1.200", None)], "id string, funding string, employee_range string, headcount int")
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 1.08), (None, 2.0), ("USD", 1.0)], "currency string, usd_per_unit double")
    got = {(x["record_id"], x["field_name"]): (x["low_value"], x["solution"]) for x in units.solved_quantities(r, c, rates).collect()}
    assert got == {
        ("a", "total_raised"): (1_250_000, "identity"), ("b", "total_raised"): (1_300_000, "stated"), ("d", "total_raised"): (1_250_000_000, "identity"), ("f", "total_raised"): (1_200_000_000, "stated"),
        ("g", "total_raised"): (1_250_000, "not_unique"), ("i", "total_raised"): (1_296_000, "stated"), ("c", "employee_range"): (1200, "identity"), ("e", "employee_range"): (1, "identity"), ("h", "employee_range"): (1200, "not_unique"),
    }
