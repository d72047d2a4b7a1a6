"""The propagation ends when the words stand still, however many rounds that takes."""

import numpy as np
import pytest

from lodestream.llm import reading_level

N = 30


def chain(spark):
    """Each document shares words with the next ones only, and only the ends are graded."""
    rows = [([i, i + 1, i + 2], [1, 1, 1], {0: 1.0, N - 1: 5.0}.get(i), True) for i in range(N)]
    return spark.createDataFrame(rows, "buckets array<int>, counts array<int>, grade double, english boolean")


def test_words_stand_still(spark):
    weight, value = (v[: N + 2] for v in reading_level.propagate(chain(spark)))
    docs = np.array([(weight * value)[i : i + 3].sum() / weight[i : i + 3].sum() for i in range(N)])
    docs[[0, -1]] = 1, 5
    new = np.array([docs[max(0, b - 2) : b + 1].mean() for b in range(N + 2)])
    assert np.abs(new - value)[weight > 0].max() <= reading_level.TOLERANCE


def test_no_standstill_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reading_level, "MOST_ITERATIONS", 3)
    with pytest.raises(RuntimeError, match="after 3 iterations"):
        reading_level.propagate(chain(spark))
