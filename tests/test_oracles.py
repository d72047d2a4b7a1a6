"""Every query that has SQL gives the SQL's rows."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

from lodestream.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    r = db.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns
