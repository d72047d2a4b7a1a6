"""Paged services as a data source: one partition per page, read by an injected callable."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def paged_source(name: str, fetch: Callable[[int], list[dict]], n_pages: int) -> type[DataSource]:
    """A data source class of the rows ``page int, item string (JSON)``; ``fetch`` gives a page's items and has to be
    picklable. A page that is empty ends nothing: pages are read independently, so that a lost task is one page."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(1, n_pages + 1)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for item in fetch(partition.value) or []:
                yield partition.value, json.dumps(item, ensure_ascii=False, sort_keys=True)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, item string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def read_pages(spark: SparkSession, name: str, fetch: Callable[[int], list[dict]], n_pages: int, item_schema: str) -> DataFrame:
    """The items of all pages as rows of ``item_schema``, with their page."""
    spark.dataSource.register(paged_source(name, fetch, n_pages))
    return spark.read.format(name).load().select("page", F.from_json("item", item_schema).alias("i")).select("page", "i.*")


def new_people(people: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The first row per name and page that no known name (``known``: name) equals, whatever the letter case."""
    key = F.lower(F.trim(F.col(name)))
    once = people.withColumn("_k", key).filter(F.col("_k") != "").dropDuplicates(["page", "_k"])
    return once.join(known.select(F.lower(F.trim("name")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
