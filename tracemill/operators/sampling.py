"""Deterministic samples and orders: stratified by digest, interleaved, shuffled, packed into budgets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.scan import scan

#: The state of the shuffle's generator where a seed's digest begins with zeros.
FALLBACK_STATE = 0x9E3779B9


def draw_key(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def stratified(df: DataFrame, stratum: str, n: int, seed: str, id: str, digest: Column) -> DataFrame:
    """n rows of each stratum, the first by a digest of seed, stratum, id and content."""
    order = W.partitionBy(stratum).orderBy(draw_key(seed, F.col(stratum), F.col(id), digest), id)
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)


def run_matrix(tasks: DataFrame, models: DataFrame, harnesses: DataFrame, trials: int, limit: int = 100_000) -> DataFrame:
    """Every combination of three small dimensions and the trials; more than ``limit`` cells are an error."""
    cells = tasks.count() * models.count() * harnesses.count() * trials
    if cells > limit:
        raise ValueError(f"{cells} cells: over the limit of {limit}")
    numbers = tasks.sparkSession.range(1, trials + 1).withColumnRenamed("id", "trial_id")
    return tasks.crossJoin(models).crossJoin(harnesses).crossJoin(numbers)


def _bounded(queue: DataFrame, limit: int) -> None:
    if (n := queue.count()) > limit:
        raise ValueError(f"{n} entries: over the limit of {limit}")


def interleave(df: DataFrame, group: str, order: list[str], limit: int = 100_000) -> DataFrame:
    """Round robin over a queue's groups, in the order in which they first appear: adds position, from 0. Positions are
    global, so a queue longer than ``limit`` is an error."""
    _bounded(df, limit)
    inside = F.row_number().over(W.partitionBy(group).orderBy(*order))
    first = F.min(F.struct(*order)).over(W.partitionBy(group))
    rows = df.withColumn("__round", inside).withColumn("__first", first)
    return rows.withColumn("position", F.row_number().over(W.orderBy("__round", "__first", group)) - 1).drop("__round", "__first")


def permutation(n: int, seed: str) -> list[int]:
    """A seeded Fisher-Yates shuffle of 0 to n - 1, with a 32-bit xorshift generator; for queues, whose length is bounded."""
    out = list(range(n))
    state = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:4], "big") or FALLBACK_STATE
    for k in range(n - 1, 0, -1):
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state ^= (state << 5) & 0xFFFFFFFF
        j = state % (k + 1)
        out[k], out[j] = out[j], out[k]
    return out


def shuffled(queue: DataFrame, order: list[str], seed: str, limit: int = 100_000) -> DataFrame:
    """The queue's rows with a position of the seeded shuffle; a queue longer than ``limit`` is an error."""
    n = queue.count()
    if n > limit:
        raise ValueError(f"{n} entries: over the limit of {limit}")
    at = [0] * n
    for position, k in enumerate(permutation(n, seed)):
        at[k] = position
    places = queue.sparkSession.createDataFrame(list(enumerate(at)), "__k long, position long")
    return queue.withColumn("__k", F.row_number().over(W.orderBy(*order)).cast("long") - 1).join(F.broadcast(places), "__k").drop("__k")  # at most limit rows


def chunks(budget: int) -> Callable[[], Callable[[float | None], int]]:
    """Folds that number chunks of sizes."""

    def begin() -> Callable[[float | None], int]:
        chunk, used = 0, 0

        def cut(size: float | None) -> int:
            nonlocal chunk, used
            if used and used + (size or 0) > budget:
                chunk, used = chunk + 1, 0
            used += size or 0
            return chunk

        return cut

    return begin


def budget_chunks(df: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Numbers chunks of consecutive rows whose sizes add to the budget at most; a larger row is a chunk of its own, and a
    null size counts nothing. A task keeps one chunk's size, not the group."""
    return scan(df, [by], order, [size], chunks(budget), "chunk", "long")


def fitting(budget: int) -> Callable[[], Callable[[float | None], bool]]:
    """Folds that tell which sizes still fit."""

    def begin() -> Callable[[float | None], bool]:
        left = budget

        def choose(size: float | None) -> bool:
            nonlocal left
            fits = size is not None and size <= left
            left -= size if fits else 0
            return fits

        return choose

    return begin


def select_evidence(df: DataFrame, by: str, tier: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Whole occurrences, tier by tier, while they fit into the budget; one that doesn't fit, or has no size, is passed over,
    never cut. A task keeps what is left of the budget, not the group."""
    return scan(df, [by], [tier, *order], [size], fitting(budget), "selected", "boolean")


def pack_context(df: DataFrame, by: str, order: list[str], size: str, note: str, budget: int) -> DataFrame:
    """Rows in order while their sizes fit into the budget. A row left out costs its note, for which the last rows that
    were taken give way where it no longer fits: adds included. Groups are read one after the other from sorted rows; one
    is held until its end, as its last row may still turn the first one out, so it is to be bounded."""
    import math

    import pyarrow as pa

    def packed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        keys, sizes, notes = ([math.nan if v is None and c != by else v for v in rows[c].to_pylist()] for c in (by, size, note))
        included, taken, used = [False] * len(keys), [], 0
        for k, s in enumerate(sizes):
            if k and not same(keys[k], keys[k - 1]):
                taken, used = [], 0
            if used + s <= budget:
                taken.append(k)
                included[k] = True
                used += s
                continue
            used += notes[k]
            while used > budget and taken:
                last = taken.pop()
                included[last] = False
                used += notes[last] - sizes[last]
        yield from rows.append_column("included", pa.array(included, pa.bool_())).to_batches()

    def same(a: object, b: object) -> bool:
        return a == b or (a != a and b != b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = b[by].to_pylist()
            if not keys:
                continue
            start = len(keys) - 1
            while start and same(keys[start - 1], keys[-1]):
                start -= 1
            if start or (held and not same(key, keys[0])):
                yield from packed([*held, b.slice(0, start)])
                held = []
            held.append(b.slice(start))
            key = keys[-1]
        if held:
            yield from packed(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", included boolean"
    return df.repartition(by).sortWithinPartitions(by, *(F.asc_nulls_last(c) for c in order)).mapInArrow(run, schema)


def compile_queue(cells: DataFrame, experiment: str, strategy: str, seed: str) -> DataFrame:
    """A run matrix as an ordered queue: position and run_id, a digest of the experiment and the cell.

    Strategies: declared (by task, model, harness, trial), shuffled, by-task, by-model or by-harness (round robin).
    """
    order = ["task_id", "model_id", "harness_id", "trial_id"]
    if strategy == "shuffled":
        queue = shuffled(cells, order, seed)
    elif strategy == "declared":
        _bounded(cells, 100_000)
        queue = cells.withColumn("position", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    elif strategy in ("by-task", "by-model", "by-harness"):
        queue = interleave(cells, strategy.removeprefix("by-") + "_id", order)
    else:
        raise ValueError(f"no such order: {strategy}")
    cell = F.to_json(F.struct(F.lit(experiment).alias("experiment"), *order))
    return queue.withColumn("run_id", F.concat(F.lit("run-"), F.substring(F.sha2(cell, 256), 1, 24)))


def queue_breaches(queue: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the matrix that the queue lacks or repeats, and entries that the matrix lacks."""
    order = ["task_id", "model_id", "harness_id", "trial_id"]
    per = queue.groupBy(*order).agg(F.count("*").alias("n"))
    both = cells.select(*order, F.lit(True).alias("declared")).join(per, order, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("n") > 1, "repeated")
    return both.select(*order, problem.alias("problem")).where("problem IS NOT NULL")
