"""Readers and writers of files, and the progress table of resumable jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, kind: str, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """parquet, json, csv (with header), xml (needs rowTag), orc or text."""
    if kind not in ("parquet", "json", "csv", "xml", "orc", "text"):
        raise ValueError(f"no reader for {kind}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def swap(df: DataFrame, root: str) -> str:
    """Writes a new version of a table beside the old one and returns its path; the path being read is never
    overwritten, and a reader of the old version is not disturbed."""
    path = f"{root.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def board_directory(spark: SparkSession, path: str) -> DataFrame:
    """board, name, slug, url of a folder of CSV files, one per board, the last row of a slug winning."""
    rows = read(spark, "csv", path, "name string, slug string, url string").withColumn("board", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return rows.filter(F.trim("slug") != "").groupBy("board", F.lower(F.trim("slug")).alias("slug")).agg(F.last("name").alias("name"), F.last("url").alias("url"))


PROGRESS = "run_id string, status string, position string, n_done long, heartbeat timestamp"


def resume_position(progress: DataFrame, run_id: str) -> str | None:
    """Where a run goes on: null if it never ran or has ended."""
    row = progress.filter((F.col("run_id") == run_id)).agg(F.max_by(F.struct("status", "position"), "heartbeat").alias("p")).first()
    return None if row is None or row["p"] is None or row["p"]["status"] == "done" else row["p"]["position"]


def rows_as_maps(df: DataFrame, name: str = "row") -> DataFrame:
    """One map of trimmed lower-case header to text per row, whatever the headers are."""
    pairs = [F.struct(F.lit(c.strip().lower()), F.trim(F.col(f"`{c}`").cast("string"))) for c in df.columns]
    return df.select(F.map_from_entries(F.array(*pairs)).alias(name))
