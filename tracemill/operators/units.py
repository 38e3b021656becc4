"""Logical operations, behavior units, parent chains and call tracks."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.scan import scan
from tracemill.sources.scratch import written


def group_operations(records: DataFrame, key: list[str]) -> DataFrame:
    """Native records of one logical operation: a row with its span, records, outcome and whether kinds are mixed."""
    return records.groupBy(*key).agg(
        F.min("native_order").alias("started"),
        F.max("native_order").alias("ended"),
        F.count("*").alias("records"),
        F.bool_or("failed").alias("failed"),
        (F.count_distinct("event_type") > 1).alias("mixed"),
    )


def operation_summary(ops: DataFrame, by: list[str]) -> DataFrame:
    return ops.groupBy(*by).agg(F.count("*").alias("operations"), F.count_if("failed").alias("failed_operations"), F.sum("records").alias("native_records"), F.count_if("mixed").alias("mixed"))


def inside_share(df: DataFrame, category: str, inside: Column) -> DataFrame:
    """Per category: rows inside and outside of windows, and the category's share of each."""
    per = df.groupBy(category).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))
    every = W.partitionBy()  # categories only
    share = lambda c: F.round(F.col(c) / F.sum(c).over(every), 9).alias(f"share_{c}")
    return per.select("*", share("inside"), share("outside"))


def roots(rows: DataFrame) -> DataFrame:
    """rows: id, parent. Each id with the root of its chain and its depth, by pointer doubling; ids on or behind a cycle are marked.

    Round k joins each pointer with the pointer 2**k levels up, so a chain of n takes log2(n) joins. Every round
    ends some chain, unless only ids on or behind cycles are left: it is done when their number stays.
    """
    at = written(rows.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("parent").isNull().alias("ended")), "chains")
    open_ids = lambda: at.where("NOT ended").agg(F.count_distinct(F.struct("id"))).first()[0]
    left, before = open_ids(), None
    while left and left != before:
        above = at.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("ended").alias("__ended")).distinct()
        at = written(at.join(above, "up", "left").select("id", F.coalesce("__up", "up").alias("up"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.coalesce("__ended", F.lit(True)).alias("ended")), "chains")
        before, left = left, open_ids()
    return at.select("id", F.when(F.col("ended"), F.col("up")).alias("root"), F.when(F.col("ended"), F.col("steps")).alias("depth"), (~F.col("ended")).alias("in_cycle"))


def sequence_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def first_fit() -> Callable[[float, float], int]:
    """A packer of intervals that come by start: each gets the least number whose last one has ended."""
    busy: list[tuple[float, int]] = []
    free: list[int] = []

    def place(start: float, end: float) -> int:
        while busy and busy[0][0] <= start:
            heapq.heappush(free, heapq.heappop(busy)[1])
        track = heapq.heappop(free) if free else len(busy)
        heapq.heappush(busy, (end, track))
        return track

    return place


def pack_tracks(calls: DataFrame, by: str, id: str) -> DataFrame:
    """Overlapping calls (by, id, start, end) in tracks: each takes the first track that is free when it starts. A task
    keeps the calls that are running, not the group."""
    return scan(calls, [by], ["start", "end", id], ["start", "end"], first_fit, "track", "long")


def stable_event_id(*parts: Column) -> Column:
    return F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32))


def retry_chain(attempts: DataFrame, id: str, retry_of: str) -> DataFrame:
    """Each attempt with the first one of its chain of retries and its place in it."""
    return roots(attempts.select(F.col(id).alias("id"), F.col(retry_of).alias("parent"))).select(F.col("id").alias(id), F.col("root").alias("first_attempt"), (F.col("depth") + 1).alias("try_number"), "in_cycle")
