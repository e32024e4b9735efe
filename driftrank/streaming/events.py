"""Structured Streaming over event tables: windows with late data, dedupe, running counters, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftrank.operators import keyed
from driftrank.operators.relational import keep_last
from driftrank.operators.store import exists


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, by, n, total: counts and sums by tumbling or sliding window; works on a stream and on a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the allowed lateness."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """key, seen: how many events of the key came so far, after each micro-batch that brings some."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((seen,))
        yield pd.DataFrame({key: [k[0]], "seen": [seen]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, seen long", "seen long", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, folder: str, key: list[str], checkpoint: str, sequence: str, buckets: int = 64):
    """Keeps the last row of each key, by `sequence`, in a keyed table; a later batch's row replaces an earlier one's. A micro-batch
    rewrites the buckets of its own keys alone, and one that is run again after a failure gives the same state."""
    spark = stream.sparkSession
    if not exists(spark, f"{folder}/manifests"):
        keyed.create(spark, folder, stream.schema, key, buckets)

    def write(batch: DataFrame, _: int) -> None:
        keyed.merge(keep_last(batch, key, sequence), folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
