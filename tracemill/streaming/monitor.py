"""A running campaign as a stream: accumulators for each attempt, state transitions, quiet attempts.

Event-time windows and watermarks are this engine's addition; the rest keeps state for each attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.functions.text import parsed_json
from tracemill.sources.shipping import ship

QUIET_SECONDS = 120


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of growing JSONL: new files become rows; lines that don't parse are left out, not fatal."""
    lines = spark.readStream.format("text").load(path)
    return lines.where(parsed_json(F.col("value")).isNotNull()).select(F.from_json("value", schema).alias("x")).select("x.*")


def accumulators(events: DataFrame, by: str, counted: dict[str, Column], known: Column | None = None) -> DataFrame:
    """Running counts for each attempt. Where ``known`` is false for all of its rows, counts are null, not 0."""
    counts = [F.count_if(c).alias(k) for k, c in counted.items()]
    if known is not None:
        counts = [F.when(F.bool_or(known), F.count_if(c)).alias(k) for k, c in counted.items()]
    return events.groupBy(by).agg(F.count("*").alias("records"), *counts)


def windowed(events: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))


def transitions(events: DataFrame, by: str, order: str, state: str) -> DataFrame:
    """A row for each change of an attempt's state, before and after; state is kept between batches."""
    ship(events.sparkSession)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        before = kept.get[0] if kept.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(order)
        for at, after in zip(rows[order], rows[state], strict=True):
            if after != before:
                out.append((key[0], at, before, after))
                before = after
        kept.update((before,))
        yield pd.DataFrame(out, columns=["key", "at", "before", "after"])

    kinds = dict(events.dtypes)
    schema = f"key {kinds[by]}, at {kinds[order]}, before string, after string"
    return events.select(by, order, state).groupBy(by).applyInPandasWithState(fold, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def quiet(totals: DataFrame, last: str, now: Column, running: Column, seconds: int = QUIET_SECONDS) -> DataFrame:
    """Attempts that run and have not answered for a while."""
    return totals.withColumn("quiet", running & (F.unix_timestamp(now) - F.unix_timestamp(last) >= seconds))


def campaign_totals(status: DataFrame) -> DataFrame:
    """status: attempt, state, charged, reserved, requests (null where unknown)."""
    return status.agg(F.count("*").alias("attempts"), F.sum("charged").alias("charged"), F.sum("reserved").alias("reserved"), F.sum("requests").alias("requests"), F.count_if(F.col("requests").isNull()).alias("unknown"), F.count_if(F.col("state") == "running").alias("running"))


def snapshots(totals: DataFrame, path: str, checkpoint: str, seconds: int = 2) -> StreamingQuery:
    """Writes the whole current state on a timer; a batch that runs again replaces its own snapshot."""

    def write(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(write).start()


def replay(frame: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Runs a streaming frame over all that is there, and ends."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
