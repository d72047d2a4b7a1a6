"""All queries of the core and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans import catalogue, corpus, oracles, streams, updates
from lodestream.runtime import ship

FLAGSHIP = "p3_found"

Query = Callable[[SparkSession, str], DataFrame]


def in_utc(query: Query) -> Query:
    """Days, months and local times of a query are those of UTC whatever the session was started with, and its Python
    workers have the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {name: in_utc(query) for name, query in (corpus.QUERIES | catalogue.QUERIES | updates.QUERIES | streams.QUERIES).items()}
ORACLES: dict[str, str] = corpus.ORACLES | oracles.ORACLES | updates.ORACLES | streams.ORACLES
