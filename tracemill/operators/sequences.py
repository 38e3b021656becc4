"""Sequence operators as window scans: as-of and nearest joins, islands, chains, carried and running values.

None is a non-equi join: two sides meet in a union that one exchange by the partition keys orders, so a
plan has one shuffle and one sort whatever the distance between matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.scan import scan


def _both(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str) -> DataFrame:
    """Both sides as (by, __at, __left: the left row, __right: the right row)."""
    one = left.select(*by, F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__left"))
    two = right.select(*by, F.col(right_at).alias("__at"), F.struct(*right.columns).alias("__right"))
    return one.unionByName(two, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, prefix: str, strict: bool = True) -> DataFrame:
    """Each left row with the right row that comes last before it (or, not strict, with it); ties by the right row itself."""
    rows = _both(left, right, by, left_at, right_at)
    first = F.when(F.col("__left").isNotNull(), 0 if strict else 1).otherwise(1 if strict else 0)
    w = W.partitionBy(*by).orderBy("__at", first, F.col("__right").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__left IS NOT NULL")
    return found.select(*(F.col("__left")[c].alias(c) for c in left.columns), *(F.col("__found")[c].alias(prefix + c) for c in right.columns if c not in by))


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, tolerance: float, prefix: str) -> DataFrame:
    """Each left row with the right row nearest to it, if within the tolerance; of two as near, the earlier one, and of
    several at one time the least.

    Rows meet in stretches of the order, so that a group is bounded by what lies in one and not by how often its key
    comes; a right row stands in every stretch that its tolerance reaches, a left row in its own.
    """
    stretch = lambda at, by: F.floor((at + F.lit(by)) / F.lit(8 * tolerance or 1))
    reach = tolerance * 1.001  # beyond what rounding may take off a fraction
    lefts = left.withColumn("__stretch", stretch(F.col(left_at), 0))
    rights = right.withColumn("__stretch", F.explode(F.sequence(stretch(F.col(right_at), -reach), stretch(F.col(right_at), reach))))
    rows = _both(lefts, rights, [*by, "__stretch"], left_at, right_at)
    group = W.partitionBy(*by, "__stretch")
    so_far = lambda *order: F.last("__right", ignorenulls=True).over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    # right rows at the same time sort before the left one, the least of them last; further ones after it. Read from the
    # end, since a frame without an end is gone through anew for each row
    back = so_far("__at", F.col("__right").desc_nulls_last())
    ahead = so_far(F.desc("__at"), F.col("__right").desc_nulls_first())
    found = rows.withColumn("__back", back).withColumn("__ahead", ahead).where("__left IS NOT NULL")
    away = lambda c: F.abs(F.col(c)[right_at] - F.col("__at"))
    a, b = away("__back"), away("__ahead")
    best = F.when(b.isNull() | (a <= b), F.col("__back")).otherwise(F.col("__ahead"))
    found = found.withColumn("__best", best)
    near = F.abs(F.col("__best")[right_at] - F.col("__at")) <= tolerance
    found = found.withColumn("__best", F.when(near, F.col("__best")))
    return found.select(*(F.col("__left")[c].alias(c) for c in left.columns), *(F.col("__best")[c].alias(prefix + c) for c in right.columns if c not in by))


def next_start(ops: DataFrame, domain: list[str], order: str, tool: str) -> DataFrame:
    """Each operation with the tools of all operations at the next greater order value of its domain, ties included."""
    at = ops.groupBy(*domain, order).agg(F.array_sort(F.collect_set(tool)).alias("__tools"))
    w = W.partitionBy(*domain).orderBy(order)
    ahead = at.select(*domain, order, F.lead("__tools").over(w).alias("next_tools"), F.lead(order).over(w).alias("next_order"))
    return ops.join(ahead, [*domain, order], "left")


def failure_responses(ops: DataFrame, domain: list[str], order: str, tool: str, failed: str) -> DataFrame:
    """Each failure: whether the next start is of the same tool, of others, of both (ambiguous) or there is none."""
    tools = F.col("next_tools")
    has = F.array_contains(tools, F.col(tool))
    response = F.when(tools.isNull(), "none").when(has & (F.size(tools) == 1), "same").when(has, "ambiguous").otherwise("alternate")
    return next_start(ops, domain, order, tool).where(failed).withColumn("response", response)


def islands(df: DataFrame, by: list[str], order: list[str], changes: Column, name: str = "island") -> DataFrame:
    """Numbers maximal runs: a new one begins where ``changes`` is true (null counts as true)."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__change", F.coalesce(changes, F.lit(True)).cast("int")).withColumn(name, F.sum("__change").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__change")


def failure_chains(ops: DataFrame, domain: list[str], order: str, tool: str, failed: str, id: str) -> DataFrame:
    """Consecutive failures of one tool in a domain, then the first later operation of that tool.

    Returns a row for each chain: its domain, tool, failures, first and last failure, the responding
    operation and its outcome (passed, failed, or none).
    """
    w = W.partitionBy(*domain).orderBy(order, id)
    broken = ~(F.col(failed) & F.lag(failed).over(w) & (F.col(tool) == F.lag(tool).over(w)))
    runs = islands(ops, domain, [order, id], F.when(F.col(failed), F.coalesce(broken, F.lit(True))).otherwise(F.lit(True)), "__run")
    # the next operation of the same tool, seen from each operation; from a chain's last failure it is the response
    same = W.partitionBy(*domain, tool).orderBy(order, id)
    ahead = F.struct(F.lead(id).over(same).alias("id"), F.lead(failed).over(same).alias("failed"), F.lead(order).over(same).alias("at"))
    rows = runs.withColumn("__next", ahead).where(failed)
    last = F.max(F.struct(order, id, "__next"))
    chains = rows.groupBy(*domain, tool, "__run").agg(F.count("*").alias("failures"), F.min(F.struct(order, id))[id].alias("first_failure"), last.alias("__last"))
    return chains.select(
        *domain,
        tool,
        "failures",
        "first_failure",
        F.col("__last")[id].alias("last_failure"),
        F.col("__last.__next.id").alias("response"),
        F.when(F.col("__last.__next.id").isNull(), "none").when(F.col("__last.__next.failed"), "failed").otherwise("passed").alias("next_outcome"),
    )


def repeats(ops: DataFrame, by: list[str], order: list[str], signature: list[str]) -> DataFrame:
    """Operations beyond the first of their signature, with the first one's id (the last order column)."""
    w = W.partitionBy(*by, *signature).orderBy(*order)
    whole = reduce(Column.__and__, (F.col(s).isNotNull() for s in signature))
    rows = ops.where(whole).withColumn("occurrence", F.row_number().over(w)).withColumn("first_id", F.first(order[-1]).over(w))
    return rows.where("occurrence > 1")


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def running_total(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def without_consecutive_duplicates(df: DataFrame, by: list[str], order: list[str], content: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    same = F.struct(*content).eqNullSafe(F.lag(F.struct(*content)).over(w)) & (F.row_number().over(w) > 1)
    return df.withColumn("__same", same).where("NOT __same").drop("__same")


def after_anchor(df: DataFrame, by: list[str], order: list[str], anchor: Column, n: int, name: str = "after_anchor") -> DataFrame:
    """Whether an anchor is among the n rows before each row; overlapping windows count a row once."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(name, F.coalesce(F.max(anchor.cast("int")).over(w) == 1, F.lit(False)))


def relative_time(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Seconds since the partition's first event, and the span of all of them."""
    w = W.partitionBy(*by)
    seconds = lambda c: F.unix_micros(c) / 1e6
    return df.withColumn("t_rel_seconds", seconds(F.col(at)) - seconds(F.min(at).over(w))).withColumn("span_seconds", seconds(F.max(at).over(w)) - seconds(F.min(at).over(w)))


def order_violations(df: DataFrame, domain: list[str], index: list[str], order: str) -> DataFrame:
    """Rows whose order value is less than that of the row before them in the same domain."""
    before = F.lag(order).over(W.partitionBy(*domain).orderBy(*index))
    return df.withColumn("previous_order", before).where(F.col(order) < F.col("previous_order"))


def changes_between(df: DataFrame, by: list[str], order: list[str], mark: Column, change: Column, name: str = "changes") -> DataFrame:
    """For each marked row and the next one of its partition: how many changes lie strictly between."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__n", F.count_if(change).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__own", change.cast("int")).where(mark)
    # the count up to the next mark, without that row itself
    return rows.withColumn(name, F.lead(F.col("__n") - F.col("__own")).over(w) - F.col("__n")).drop("__n", "__own")


def last_checks(df: DataFrame, by: list[str], seq: str, check: Column, failed: Column, change: Column) -> DataFrame:
    """Per partition: the last check, how it ended, the changes since and the first of them."""
    last = W.partitionBy(*by)
    rows = df.select("*", check.alias("__check"), failed.alias("__failed"), change.alias("__change"))
    rows = rows.withColumn("__last", F.max(F.when(F.col("__check"), F.col(seq))).over(last))
    after = F.col("__change") & (F.col(seq) > F.col("__last"))
    return rows.groupBy(*by).agg(
        F.max("__last").alias("last_check"),
        F.max(F.when(F.col("__check") & ~F.col("__failed"), F.col(seq))).alias("last_passed_check"),
        F.count_if(after).alias("changes_after"),
        F.min(F.when(after, F.col(seq))).alias("first_change_after"),
    )


def verdict(claimed: Column, last: Column, last_ok: Column, changes_after: Column) -> Column:
    """What the captured checks say about a claim that checks pass."""
    return (
        F.when(~claimed, "not-claimed")
        .when(last.isNull(), "no-captured-check")
        .when(~last_ok.eqNullSafe(last), "contradicted-by-last-check")
        .when(changes_after > 0, "changed-after-check")
        .otherwise("supported-by-last-check")
    )


def episodes(df: DataFrame, by: list[str], order: list[str], leads: Column) -> DataFrame:
    """Rows belong to the episode that the last lead opened; rows before any lead to episode 0."""
    return df.withColumn("episode", F.count_if(leads).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def first_per_key(df: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """One row for each key, the first by rank: reconciles sources that report one thing twice."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*rank))).where("__rank = 1").drop("__rank")


def unique_lowest(df: DataFrame, key: list[str], rank: str, value: str) -> DataFrame:
    """Per key: the value of the lowest rank, unless several rows share that rank."""
    rows = df.withColumn("__rank", F.rank().over(W.partitionBy(*key).orderBy(rank))).where("__rank = 1")
    return rows.groupBy(*key).agg(F.count("*").alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def boundaries() -> Callable[[str | None, bool], int | None]:
    """A fold that numbers the boundaries of compaction records."""
    number, seen = -1, None

    def step(kind: str | None, breaks: bool | None) -> int | None:
        nonlocal number, seen
        if kind is None:
            seen = None if breaks else seen
            return None
        if seen is None or kind in seen:
            number, seen = number + 1, set()
        seen.add(kind)
        return number

    return step


def compaction_boundaries(events: DataFrame, attempt: str, order: list[str]) -> DataFrame:
    """events: attempt, kind (null unless a compaction record), breaks (ends a boundary). Numbers the boundaries.

    Whether a record opens a new boundary depends on the kinds seen since the last one began, so each attempt
    is folded in order; a task keeps those kinds, not the attempt.
    """
    return scan(events, [attempt], order, ["kind", "breaks"], boundaries, "boundary", "long")


def correlate(left: DataFrame, right: DataFrame, keys: dict[str, Column], id: str = "id") -> DataFrame:
    """Pairs of rows of two channels that share any of several keys (such as a call id, a response id, or role and
    time), each pair once with the names of the keys that agree. keys: the same expressions on both sides."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in keys.items())))
        return df.select(F.col(id).alias(name), each.alias("x")).select(name, "x.key", "x.value").where("value IS NOT NULL")

    both = keyed(left, "left_id").join(keyed(right, "right_id"), ["key", "value"])
    return both.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("key")).alias("by"))


def spread(n: int) -> list[int]:
    """An order of 0 to n - 1 that visits the ends first and then the middles of what is left between."""
    out = [*dict.fromkeys([0, n - 1])] if n > 0 else []
    gaps = [(0, n - 1)]
    while gaps:
        following = []
        for a, b in gaps:
            if b - a > 1:
                m = (a + b) // 2
                out.append(m)
                following += [(a, m), (m, b)]
        gaps = following
    return out


def spread_order(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds visit: the place of each row in its partition's evenly spaced order.

    Halving reaches a row at a level, which follows from its place and the partition's size alone; within a level rows
    are visited from the left. So the places are one more window, without a table of sizes.
    """
    w = W.partitionBy(*by)
    rows = df.withColumn("__k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    k, last = F.col("__k"), F.col("__n") - 1
    start = F.struct(F.lit(0).cast("long").alias("a"), last.cast("long").alias("b"), F.lit(0).alias("level"))

    def halve(s: Column) -> Column:
        m = F.floor((s["a"] + s["b"]) / 2)
        done = (s["a"] == k) | (s["b"] == k)
        half = F.struct(F.when(k >= m, m).otherwise(s["a"]).alias("a"), F.when(k <= m, m).otherwise(s["b"]).alias("b"), (s["level"] + 1).alias("level"))
        return F.when(done, s).otherwise(half)

    level = F.aggregate(F.sequence(F.lit(1), F.length(F.bin("__n")) + 1), start, lambda s, _: halve(s))["level"]
    return rows.withColumn("__level", level).withColumn("visit", F.row_number().over(w.orderBy("__level", "__k")) - 1).drop("__k", "__n", "__level")
