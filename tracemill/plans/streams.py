"""Queries that run streams to their end over what is there."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans import timelines  # noqa: F401  the batch operators' SQL is registered there
from tracemill.plans.registry import ORACLES, query
from tracemill.sources import tail
from tracemill.sources.scratch import folder
from tracemill.sources.tables import operations, table
from tracemill.streaming import chains, evidence, monitor


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a stream; a glob, since a stream's source is a folder or a pattern."""
    path = f"{sf_dir}/events.parque[t]"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(spark: SparkSession, frame: DataFrame, mode: str) -> DataFrame:
    out = folder(spark, "stream-out")
    monitor.replay(frame, out, folder(spark, "stream-checkpoint"), mode)
    return spark.read.parquet(out).drop("batch")


@query("""
SELECT user_id, count(*) AS records, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS changes FROM events GROUP BY user_id
""")
def monitor_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _ran(spark, monitor.accumulators(_events(spark, sf_dir), "user_id", {"errors": kind == "error", "changes": kind == "purchase"}), "complete")


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ran(spark, monitor.windowed(_events(spark, sf_dir), "ts", ["event_type"], "1 day", "30 days"), "complete")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH l AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS key, event_id AS at, p AS before, event_type AS after FROM l WHERE n = 1 OR p <> event_type
""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, monitor.transitions(_events(spark, sf_dir), "user_id", "event_id", "event_type"), "append")


BATCHES = 3
#: A scope is closed after so long without a record; the replay's last record is later than that.
IDLE_MS = 366 * 86_400_000


def _replayed(spark: SparkSession, records: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a fold gives for records (scope, id, ts, ...) that arrive in batches of equal time, every seventh one a
    batch late. Each batch is a run of its own that goes on from the checkpoint; a far later record ends the stream."""
    arriving, out, checkpoint = (folder(spark, f"stream-{x}") for x in ("arriving", "out", "checkpoint"))
    span = records.agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last")).first()
    first, last = span["first"] or 0, span["last"] or 0
    width = (last - first) // BATCHES + 1
    batch = F.floor((F.unix_micros("ts") - first) / width) + (F.col("id") % 7 == 3).cast("int")
    end = spark.range(1).select(F.timestamp_micros(F.lit(last + 4 * IDLE_MS * 1000)).alias("ts"))
    parts = [records.where(batch == k) for k in range(BATCHES + 1)]
    with chains.state_store(spark) as own:
        for part in [*parts, records.limit(0).unionByName(end, allowMissingColumns=True)]:
            part.write.mode("append").parquet(arriving)
            stream = own.readStream.schema(records.schema).parquet(arriving)
            monitor.replay(fold(chains.timed(stream, "ts", f"{2 * width} microseconds")), out, checkpoint, "append")
    return spark.read.parquet(out).drop("batch")


@query(ORACLES["failure_chains"])
def failure_chains_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    records = ops.select(F.col("session_id").alias("scope"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("tool_name").alias("tool"), "failed")
    found = _replayed(spark, records, lambda r: chains.failure_chains(r, "scope", IDLE_MS))
    return found.select(F.col("scope").cast("long").alias("session_id"), F.col("tool").alias("tool_name"), "failures", "first_failure", "last_failure", "response", "next_outcome")


@query(f"""
SELECT session_id, boundary, count(*) AS records, min(event_id) AS first_record, max(event_id) AS last_record, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds
FROM ({ORACLES["compaction_boundaries"]}) GROUP BY session_id, boundary
""")
def compaction_boundaries_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "signup"), F.concat(F.col("event_type"), (F.col("input_digest") % 3).cast("string")))
    records = operations(spark, sf_dir).select(F.col("session_id").alias("scope"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("failed").alias("breaks"))
    found = _replayed(spark, records, lambda r: chains.compaction_boundaries(r, "scope", IDLE_MS))
    return found.select(F.col("scope").cast("long").alias("session_id"), "boundary", "records", "first_record", "last_record", F.array_join("kinds", " ").alias("kinds"))


#: Rows of a growing file, about; a file is written by one task.
LOG_ROWS = 5_000


def _grown(logs: DataFrame, root: str, step: int) -> None:
    """Files of logs (file, step, event_id, line) as they stand after a step. Step 0 leaves its last line without an
    end, step 1 goes on behind it; step 2 writes on, truncates and starts anew, or puts another file in its place, by
    the file's number. A task that runs again leaves the same files: each step knows where it begins."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pathlib import Path

        lines: dict[int, list[list[str]]] = {}
        for b in batches:
            for r in b.to_pylist():
                lines.setdefault(r["file"], [[], [], []])[r["step"]].append(r["line"])
        for number, parts in lines.items():
            first, second, third = ("".join(f"{x}\n" for x in p).encode() for p in parts)
            path, open_end = Path(root) / f"log-{number}.jsonl", max(len(first) - 8, 0)
            if step == 0:
                path.write_bytes(first[:open_end])
            elif step == 1 or number % 3 == 0:
                at, rest = (open_end, first[open_end:] + second) if step == 1 else (len(first + second), third)
                with open(path, "r+b") as f:
                    f.seek(at)
                    f.truncate()
                    f.write(rest)
            elif number % 3 == 1:
                path.write_bytes(third)
            else:
                new = path.with_suffix(".new")
                new.write_bytes(third)
                os.replace(new, path)
            yield pa.RecordBatch.from_pydict({"file": [number]})

    logs.repartition("file").sortWithinPartitions("file", "event_id").mapInArrow(write, "file long").write.format("noop").mode("overwrite").save()


@query("SELECT event_id, user_id, event_type, value FROM events")
def growing_files_tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of files that grow, are truncated and replaced between batches: every line comes once. The files
    lie in the shared folder, which must be one that tasks can open by its path."""
    events = table(spark, sf_dir, "events")
    files = max(6, events.count() // LOG_ROWS)
    logs = events.select((F.col("user_id") % files).alias("file"), (F.col("event_id") % 3).cast("int").alias("step"), "event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("line"))
    root, out, checkpoint = (folder(spark, f"tail-{x}") for x in ("logs", "out", "checkpoint"))
    local = root.removeprefix("file://")
    os.makedirs(local, exist_ok=True)
    stream = tail.tail_json(spark, local, "event_id long, user_id long, event_type string, value double")
    for step in range(3):
        _grown(logs, local, step)
        monitor.replay(stream, out, checkpoint, "append")
    return spark.read.parquet(out).drop("batch")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) - 1 AS sequence FROM events
""")
def evidence_log_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches to a log for each user; every batch fails twice on its way and is started again."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    arriving, out, checkpoint = (folder(spark, f"evidence-{x}") for x in ("arriving", "log", "checkpoint"))
    log, failed = evidence.EvidenceLog(spark, out, "user_id", ["event_id"]), set()

    def fail(batch: int, stage: str) -> None:
        if (batch, stage) not in failed:
            failed.add((batch, stage))
            raise RuntimeError(f"batch {batch} is to fail after its {stage}")

    for batch in range(3):
        events.where(F.col("event_id") % 3 == batch).write.mode("append").parquet(arriving)
        while True:
            try:
                log.sink(spark.readStream.schema(events.schema).parquet(arriving), checkpoint, fail).awaitTermination()
                break
            except StreamingQueryException:
                if len(failed) > 2 * (batch + 1):
                    raise
    return log.read().select("user_id", "event_id", "sequence")
