"""Streaming forms of the stateful operators: the same results as the batch forms over the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.config import DEFAULTS
from lodestream.operators.events import CLUSTERED, ClusterFold
from lodestream.runtime import stage_dir


def distinct_events(stream: DataFrame, at: str, keys: list[str], lateness: str = "30 days") -> DataFrame:
    """The first row of each key; keys are forgotten after the lateness, so the state is bounded by time."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, at: str, width: str, limit: int, lateness: str = "1 hour", headroom: float = DEFAULTS.headroom) -> DataFrame:
    """window_start, n_calls, n_admitted per tumbling window; rows later than the lateness are dropped."""
    counts = stream.withWatermark(at, lateness).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n_calls"))
    return counts.select(F.col("window.start").alias("window_start"), "n_calls", F.least("n_calls", F.lit(int(limit * headroom))).alias("n_admitted"))


def snapshot_changes(stream: DataFrame, key: str, at: str, count: str, ratio: float = DEFAULTS.surge_ratio, lateness: str = "30 days", forget_days: int = 400) -> DataFrame:
    """Surges against the last snapshot of the key, which with its time is all the state there is of it.

    A snapshot that comes after a newer one of its key was compared is late and changes nothing. A key without a
    snapshot for ``forget_days`` behind the watermark is forgotten, so that the state doesn't grow for ever.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        prev, last = state.get if state.exists else (None, None)
        for r in pd.concat(list(batches)).sort_values([at]).itertuples(index=False):
            when = getattr(r, at)
            if last is not None and when.value // 1000 < last:
                continue
            now = getattr(r, count)
            now = 0 if pd.isna(now) else int(now)
            if prev and now >= prev * ratio:
                yield pd.DataFrame([(k[0], when, prev, now)], columns=[key, at, "prev_count", "curr_count"])
            prev, last = now, when.value // 1000
        state.update((prev, last))
        due = last // 1000 + forget_days * 86_400_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = stream.select(key, at, count).filter(F.col(at).isNotNull()).withWatermark(at, lateness)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, {at} timestamp, prev_count long, curr_count long", "prev long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def clustered_events(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The ordered fold of reports per company and type. The events a later report can still reach are the state; it
    is dropped when the watermark has passed it by the look-back. Emits an event's row whenever it changes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold = ClusterFold(key[1], json.loads(state.get[0]) if state.exists else [])
        changed: dict[str, dict] = {}
        for r in pd.concat(list(batches)).sort_values(["observed_at", "dedupe_key"]).to_dict("records"):
            clean = {k: (None if pd.isna(v) else v) for k, v in r.items()}
            what, e = fold.add({"key": clean["dedupe_key"], "at": clean["observed_at"].timestamp(), "title": clean["title"] or "", "url": clean["url"], "confidence": clean["confidence"] if clean["confidence"] is not None else 0.85, "story": clean["story"], "person": clean["person"], "amount": clean["amount"]})
            if what != "known":
                changed[e["key"]] = e
        newest = max(e["at"] for e in fold.kept)
        fold.kept = [e for e in fold.kept if e["at"] >= newest - 2 * DEFAULTS.cluster_days * 86400]
        state.update((json.dumps(fold.kept),))
        due = int((newest + 2 * DEFAULTS.cluster_days * 86400) * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], key[1], e["key"], e["title"], pd.Timestamp(round(e["at"] * 1e6), unit="us"), round(e["confidence"], 6), e["n_reports"]) for e in changed.values()]
        yield pd.DataFrame(rows, columns=["company_id", "event_type", "dedupe_key", "title", "observed_at", "confidence", "n_reports"])

    return stream.withWatermark("observed_at", lateness).groupBy("company_id", "event_type").applyInPandasWithState(step, CLUSTERED, "kept string", "update", GroupStateTimeout.EventTimeTimeout)


def read_stream(spark: SparkSession, directory: str, table: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table's parquet files as a stream; a table that is one file is a stream of one file."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{directory}/{table}.parquet*")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns the written table. Exactly once: the sink's log and the
    checkpoint lie in the shared folder."""
    import uuid

    spark = stream.sparkSession
    root = f"{stage_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, n: int) -> None:
            batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/_b={n}")

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{root}/out") if mode == "append" else spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return out
