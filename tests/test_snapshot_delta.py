from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestream.operators import snapshot_delta as sd
from lodestream.operators.hashing import xxhash64_longs

SCHEMA = "snapshot_on date, company_id string, external_id string, title string, location string, first_seen_at timestamp, delivered_at timestamp, extra string"
D = [date(2025, 1, d) for d in (6, 13, 20)]
T = datetime(2025, 1, 1)


def row(d, c, e, t="T", loc="L", seen=T, at=T, x="x"):
    return (d, c, e, t, loc, seen, at, x)


def test_hash_is_sparks(spark):
    a, b = [1, -5, 2**62], [0, 7, -(2**63)]
    got = [r[0] for r in spark.createDataFrame(list(zip(a, b)), "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert got == xxhash64_longs(np.array(a), np.array(b)).tolist()


def test_kinds_and_spelling(spark):
    rows = [
        row(D[0], "c", " AB-1 "), row(D[1], "c", "ab-1", "t ", " l"),  # same
        row(D[0], "c", "b", "Café"), row(D[1], "c", "B", "café"),  # same after composition
        row(D[0], "c", "x", "one"), row(D[1], "c", "x", "two"),
        row(D[0], "c", "gone"), row(D[1], "c", "new"),
        row(D[0], "c", "n", None), row(D[1], "c", "n", ""),  # null equals null only
        row(D[0], "c", "s", seen=datetime(2025, 1, 1, 0, 0, 0, 5)), row(D[1], "c", "s", seen=T),
        row(D[0], "c", None), row(D[1], "c", "  "), row(D[1], None, "q"),
    ]
    got = run_set(spark, rows)
    assert got == {("2025-01-13", "c", "x", "changed"), ("2025-01-13", "c", "gone", "removed"), ("2025-01-13", "c", "new", "added"), ("2025-01-13", "c", "n", "changed"), ("2025-01-13", None, "q", "added")}


def run_set(spark, rows, **kw):
    return {tuple(r) for r in sd.snapshot_changes(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_latest_delivery_and_gap(spark):
    late = datetime(2025, 2, 1)
    rows = [row(D[0], "c", "a"), row(D[0], "c", "a", "late", at=late), row(D[0], "c", "a", "late", at=late), row(D[2], "c", "a", "late"), row(D[1], "c", "z"), row(D[0], "c", "z"), row(D[2], "c", "z")]
    assert run_set(spark, rows) == {("2025-01-13", "c", "a", "removed"), ("2025-01-20", "c", "a", "added")}


def test_empty_and_single(spark):
    assert run_set(spark, []) == set()
    assert run_set(spark, [row(D[0], "c", "a")]) == set()


def test_enlarges_failed_buckets(spark):
    """Everything differs, so that the first tables are far too small."""
    rows = [row(D[0], "c", f"a{i}") for i in range(700)] + [row(D[1], "c", f"b{i}") for i in range(700)]
    got = run_set(spark, rows, rows_per_bucket=300, first_cells=0.1)
    assert len(got) == 1400 and sum(k == "added" for *_, k in got) == 700


def test_peel_refuses_a_full_table():
    cells = pd.DataFrame({"cell": [0, 1, 2], "n": [67, 66, 66], "key_xor": [1, 2, 3], "value_xor": [4, 5, 6], "check_xor": [7, 8, 9]})
    assert sd.peel(cells, 3)[0] is None
