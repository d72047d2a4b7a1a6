import pytest

from lodestream.plans import jobs
from lodestream.sources import pages


def test_steps_are_isolated(spark):
    log = jobs.JobLog(spark)

    def broken():
        raise ValueError("no")

    got = jobs.run_steps(log, "j1", "daily", [("a", lambda: spark.range(3)), ("b", broken), ("c", lambda: None)])
    assert got == {"a": "completed", "b": "failed", "c": "completed"}
    rows = {r["step"]: r for r in log.table().collect()}
    assert rows["a"]["n_rows"] == 3 and rows["b"]["error"] == "ValueError: no" and rows["c"]["n_rows"] is None


def test_retries_only_passing_errors():
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("Connection reset by peer")
        return 7

    assert jobs.retried(flaky, sleep=waits.append) == 7 and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        jobs.retried(lambda: int("x"), sleep=waits.append)


def test_pages(spark):
    def fetch(page):
        return [{"name": f"P{page}"}, {"name": f"p{page} "}, {"name": "Known"}] if page < 3 else []

    people = pages.read_pages(spark, "people_pages", fetch, 3, "name string")
    assert people.count() == 6
    known = spark.createDataFrame([("KNOWN",)], "name string")
    assert sorted(r["name"].strip().lower() for r in pages.new_people(people, known, "name").collect()) == ["p1", "p2"]
