from datetime import datetime as dt

from lodestream.operators import event_features as ef
from lodestream.operators import orphans as o

EVENTS = "id long, company_id string, event_type string, dedupe_key string, observed_at timestamp, confidence double, extra int"


def test_counts_windows_recency(spark):
    rows = [
        (1, "a", "Role Spike", "k1", dt(2025, 1, 1), 0.5, 1), (2, "a", " role-spike", "k1", dt(2025, 1, 3), 0.5, 1),  # one event
        (3, "a", "role_spike", "k2", dt(2025, 1, 20), 80.0, 1), (4, "a", "ROLE_SPIKE", "k3", dt(2025, 1, 30), None, 1),
        (5, "a", None, "k4", dt(2025, 1, 2), 0.1, 1), (6, "b", " ", "k5", dt(2025, 1, 2), 0.1, 1), (7, "b", "x", None, None, 0.4, 1), (8, "b", "x", None, dt(2025, 2, 9), 0.4, 1),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    assert {tuple(r) for r in ef.event_counts(df).collect()} == {("a", "role_spike", 3), ("b", "x", 2)}
    got = {r["company_id"]: r.asDict(recursive=True) for r in ef.entity_features(df, "2025-01-31", (7, 30)).collect()}
    f = got["a"]["features"]["role_spike"]
    assert (f["n_events"], f["total_confidence"], f["days_since_last"], f["n_events_7d"], f["n_events_30d"]) == (3, 1.3, 1, 1, 2)
    b = got["b"]["features"]["x"]
    assert (b["n_events"], b["days_since_last"], b["n_events_30d"]) == (1, None, 0)


def test_features_of_nothing(spark):
    df = spark.createDataFrame([], EVENTS)
    assert ef.event_counts(df).count() == 0 and ef.entity_features(df, "2025-01-31").count() == 0


HEX = "0123456789abcdef0123456789abcdef"
UUID = "01234567-89ab-cdef-0123-456789abcdef"


def test_reference_keys(spark):
    texts = [UUID, UUID.upper(), "{" + UUID + "}", "urn:uuid:" + UUID, HEX, f" {UUID} ", None, "", " ", "n/a", "None", "null", "legacy-1", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(o.reference_key(df.t)).collect()]
    assert got == [HEX] * 6 + [None] * 6 + ["text:legacy-1", "text:abc"]


def orphans(spark, refs, targets, removed):
    r = o.references(spark.createDataFrame(refs, "id string, ref string, at timestamp, extra string"), "t", "id", "ref", "at")
    t = spark.createDataFrame(targets, "id string, created_at timestamp")
    g = spark.createDataFrame(removed, "discovery_company_id string")
    return {tuple(x) for x in o.orphan_records(r, t, g).collect()}


def test_orphan_kinds(spark):
    ids = [f"{i:032x}" for i in range(6)]
    refs = [("r0", ids[0], dt(2025, 1, 5), "x"), ("r0", ids[0], dt(2025, 1, 5), "x"), ("r1", ids[1].upper(), dt(2025, 2, 5), "x"), ("r2", ids[2], dt(2025, 3, 5), "x"), ("r3", ids[3], dt(2025, 3, 5), "x"), ("r4", None, dt(2025, 3, 5), "x"), ("r5", "zz", None, "x")]
    refs += [(f"hot{i}", ids[4], dt(2025, 1, 1 + i % 20), "x") for i in range(60)]
    targets = [(ids[0], dt(2025, 1, 1)), (ids[0], dt(2026, 1, 1)), (ids[1], dt(2025, 3, 1)), (ids[4], dt(2025, 1, 10))]
    got = orphans(spark, refs, targets, [(ids[2],), (ids[0],)])
    cold = {x for x in got if not x[1].startswith("hot")}
    assert cold == {("t", "r1", "late", "2025-02"), ("t", "r2", "deleted", "2025-03"), ("t", "r3", "missing", "2025-03"), ("t", "r5", "missing", None)}
    assert {x[1] for x in got if x[1].startswith("hot")} == {f"hot{i}" for i in range(60) if 1 + i % 20 < 10}


def test_no_targets(spark):
    assert orphans(spark, [("a", HEX, dt(2025, 1, 1), "x")], [], []) == {("t", "a", "missing", "2025-01")}
    assert orphans(spark, [], [], []) == set()
