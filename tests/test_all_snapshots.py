"""close_missing goes over all snapshots of the table."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestream.operators import merge
from lodestream.plans import registry

SCHEMA = "snapshot_on date, company_id string, external_id string"


def rows():
    """Five dates at odd distances; companies that aren't polled on all of them, posts that come back, and blanks."""
    rnd = random.Random(5)
    dates = [datetime.date(2024, 1, d) for d in (1, 3, 4, 11, 30)]
    out = [(d, f"c{c}", rnd.choice(("p{}", " P{} ")).format(p)) for d in dates for c in range(8) if rnd.random() < 0.7 for p in range(8) if rnd.random() < 0.5]
    return out + out[:9] + [(dates[1], None, "p1"), (dates[2], None, "p1"), (dates[4], "c1", " "), (dates[4], "c2", None), (None, "c3", "p77")]


def fold(spark, found):
    """The operator on one snapshot after the other."""
    state = None
    for d in sorted({r[0] for r in found if r[0]}):
        batch = spark.createDataFrame(sorted({(c, e.strip().lower()) for on, c, e in found if on == d and c and e and e.strip()}), "company_id string, external_id string")
        new = batch.withColumn("closed_on", F.lit(None).cast("date"))
        if state is not None:
            old = merge.close_missing(state, batch, "company_id", "external_id", "closed_on", F.lit(d))
            new = old.unionByName(new.join(old, ["company_id", "external_id"], "left_anti"))
        state = spark.createDataFrame(new.collect(), new.schema)
    return Counter(map(tuple, state.collect()))


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/job_post_snapshot.parquet")
    return Counter(map(tuple, registry.QUERIES["close_missing"](spark, d).select("company_id", "external_id", "closed_on").collect()))


def test_as_folded(spark, got):
    assert got == fold(spark, rows()) + Counter({(None, "p1", None): 1})
    assert len({c for _, _, c in got}) > 3
