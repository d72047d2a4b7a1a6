"""The k most similar vectors are those of brute force, in blocks and batches of any size."""

import numpy as np
import pytest

from lodestream.operators import search


@pytest.mark.parametrize("n, k, block, at_once", [(300, 5, 10_000, 2_000), (300, 5, 4, 7), (7, 10, 3, 2), (300, 1, 10_000, 1)])
def test_top_k_is_exact(spark, monkeypatch, n, k, block, at_once):
    monkeypatch.setattr(search, "ROWS_AT_ONCE", at_once)
    rnd = np.random.default_rng(n + k)
    v = rnd.normal(size=(n, 6)).round(1)
    v[5 % n] = v[0]  # a tie
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(n, None), (n + 1, []), (n + 2, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, e array<float>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(6)] + [("none", None)], "query_id string, query_vector array<float>")
    got = {}
    for r in search.top_k(df, asked, "id", "e", k, 0.1, block).collect():
        got.setdefault(r.query_id, set()).add((r.id, r.score))
    u = np.array([np.float32(r[1]) for r in rows[:n]], np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(6):
        order = sorted(((round(float(s), 4), -j) for j, s in enumerate(u @ u[i]) if round(float(s), 4) >= 0.1), reverse=True)[:k]
        assert got[f"q{i}"] == {(-j, s) for s, j in order}
    assert "none" not in got


def test_no_vectors(spark):
    df = spark.createDataFrame([], "id long, e array<float>")
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, query_vector array<float>")
    assert search.top_k(df, asked, "id", "e", 3, 0.0).count() == 0 and search.top_k(df, asked.limit(0), "id", "e", 3, 0.0).count() == 0
