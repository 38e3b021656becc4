"""Evaluation aggregates: selection of attempts, metrics with counted exclusions, behaviors, variation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.availability import exclusions, measurement, or_unavailable

QUALIFIED = ("qualified", "qualified-with-gaps")


def latest_per_run(attempts: DataFrame, run: str = "run_id", number: str = "attempt_number") -> DataFrame:
    """Marks each attempt as selected (the latest of its run) and ambiguous (it shares the latest number)."""
    last = F.max(number).over(W.partitionBy(run))
    ties = F.count_if(F.col(number) == F.col("__last")).over(W.partitionBy(run))
    marked = attempts.withColumn("__last", last).withColumn("selected", F.col(number) == F.col("__last"))
    return marked.withColumn("ambiguous", F.col("selected") & (ties > 1)).drop("__last")


def select_latest(attempts: DataFrame) -> DataFrame:
    """The latest attempt of each run; two attempts with the latest number are an error."""
    marked = latest_per_run(attempts).where("selected")
    return marked.withColumn("__ok", F.assert_true(~F.col("ambiguous"), F.lit("two attempts of a run have the latest number"))).where("__ok IS NULL").drop("selected", "ambiguous", "__ok")


def grouped(df: DataFrame, dims: list[str]) -> DataFrame:
    """The dimensions made total: a missing value is the group "unavailable"."""
    return df.withColumns({d: or_unavailable(F.col(d)) for d in dims})


def attempt_metrics(marked: DataFrame, dims: list[str]) -> DataFrame:
    """Per group, the rate metrics of selected attempts; a row for each metric. marked: latest_per_run's rows."""
    s = F.col("selected")
    n = F.count_if(s)
    capture = F.col("capture_qualification")
    has_capture = s & capture.isNotNull() & (capture != "unavailable")
    made = {
        "attempt-count": measurement(n, F.count("*"), "attempt", excluded=exclusions(not_selected_by_attempt_policy=F.count_if(~s)), rate=False),
        "capture-qualified-rate": measurement(F.count_if(s & capture.isin(*QUALIFIED)), F.count_if(has_capture), "attempt", excluded=exclusions(capture_qualification_unavailable=n - F.count_if(has_capture))),
        "infrastructure-failure-rate": measurement(F.count_if(s & (F.col("terminal_state") == "failed")), n, "attempt"),
        "terminal-completed-rate": measurement(F.count_if(s & (F.col("terminal_state") == "completed")), n, "attempt"),
    }
    wide = grouped(marked, dims).groupBy(*dims).agg(*(v.alias(k) for k, v in made.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("measurement")) for k in made)))
    return wide.select(*dims, each.alias("x")).select(*dims, "x.metric", "x.measurement")


def observation_metrics(observations: DataFrame, dims: list[str]) -> DataFrame:
    """Long-form structural metrics of observations(attempt_id, *dims, extractor_id, status, num, bool, str, unit, reason).

    Numbers are summed, truths counted, categories counted by value; differing types or units in one group
    make the metric unavailable. Unavailable observations are counted exclusions, by reason.
    """
    known = F.col("status") == "known"
    kind = F.when(F.col("num").isNotNull(), "number").when(F.col("bool").isNotNull(), "boolean").when(F.col("str").isNotNull(), "string")
    rows = grouped(observations, dims).withColumn("__kind", F.when(known, kind))
    keys = [*dims, "extractor_id"]
    per = rows.groupBy(*keys).agg(
        F.count_if(known).alias("denominator"),
        F.sum(F.when(known, F.col("num"))).alias("__sum"),
        F.count_if(known & F.col("bool")).alias("__true"),
        F.collect_set(F.when(known, F.col("unit"))).alias("__units"),
        F.collect_set("__kind").alias("__kinds"),
        F.count_if(~known).alias("excluded"),
    )
    mixed = (F.size("__units") > 1) | (F.size("__kinds") > 1)
    first = F.try_element_at("__kinds", F.lit(1))
    plain = per.where(mixed | F.coalesce(first != "string", F.lit(True))).select(
        *keys,
        F.lit(None).cast("string").alias("category"),
        F.when(mixed | (F.col("denominator") == 0), "unavailable").otherwise("available").alias("status"),
        F.when(mixed, None).when(first == "number", F.col("__sum")).when(first == "boolean", F.col("__true").cast("double")).alias("numerator"),
        "denominator",
        F.when(mixed, "Structural observation types or units differ within the group.").when(F.col("denominator") == 0, "The eligible denominator is empty.").alias("reason"),
        "excluded",
    )
    categories = rows.where(F.col("__kind") == "string").groupBy(*keys, "str").agg(F.count("*").cast("double").alias("numerator"))
    by_value = categories.join(per.where(~mixed & (first == "string")).select(*keys, "denominator", "excluded"), keys)
    return plain.unionByName(by_value.select(*keys, F.col("str").alias("category"), F.lit("available").alias("status"), "numerator", "denominator", F.lit(None).cast("string").alias("reason"), "excluded"))


def behavior_distribution(judgments: DataFrame, partition: list[str], attempt: str, judgment: str) -> DataFrame:
    """Per partition: reruns that agree count an attempt once; an attempt whose reruns differ is excluded."""
    per = judgments.groupBy(*partition, attempt).agg(F.min(judgment).alias("__low"), F.max(judgment).alias("__high"), F.count(judgment).alias("__n"))
    agreed = F.when((F.col("__n") > 0) & (F.col("__low") == F.col("__high")), F.col("__low"))
    rows = per.withColumn("assessment", agreed)
    total = rows.groupBy(*partition).agg(F.count("assessment").alias("denominator"), F.count_if((F.col("__n") > 0) & F.col("assessment").isNull()).alias("conflicting"), F.count_if(F.col("__n") == 0).alias("unassessed"))
    counts = rows.where("assessment IS NOT NULL").groupBy(*partition, "assessment").agg(F.count("*").alias("numerator"))
    return counts.join(total, partition).withColumn("rate", F.try_divide("numerator", "denominator"))


def variation(df: DataFrame, dims: list[str], measure: str, recurrence_minimum: int = 2) -> DataFrame:
    """Per group: values counted, and what their spread allows to be claimed, from the second-most-frequent one."""
    counts = df.groupBy(*dims, measure).agg(F.count("*").alias("n"))
    seen = F.sort_array(F.collect_list(F.when(F.col(measure).isNotNull(), F.col("n"))), asc=False)
    per = counts.groupBy(*dims).agg(seen.alias("__counts"), F.coalesce(F.sum(F.when(F.col(measure).isNull(), F.col("n"))), F.lit(0)).alias("excluded"))
    second = F.coalesce(F.get("__counts", F.lit(1)), F.lit(0))
    status = F.when(F.size("__counts") == 0, "unavailable").when(second == 0, "no-variation").when(second >= recurrence_minimum, "recurring-description").otherwise("case-study")
    return per.select(*dims, F.size("__counts").cast("long").alias("distinct_values"), second.alias("second_most_frequent"), "excluded", status.alias("claim_status"))


def duplicates(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Keys that repeat: identical copies are duplicates, differing ones a conflict."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    per = df.groupBy(*key).agg(F.count("*").alias("copies"), F.count_distinct(digest).alias("versions")).where("copies > 1")
    return per.withColumn("status", F.when(F.col("versions") > 1, "conflict").otherwise("duplicate"))


def exclusion_counts(df: DataFrame, reason: Column) -> DataFrame:
    return df.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("count"))


def source_population(attempts: DataFrame, selected: Column) -> DataFrame:
    return attempts.agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("attempt_id").alias("attempts"), F.count_if(selected).alias("selected"), (F.count("*") - F.count_distinct("attempt_id")).alias("duplicates"))


def resource_total(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows: key, order, semantics (final, snapshot or increment), amount. Per key: a final value wins over the
    latest snapshot, and that over the sum of increments; finals that differ make the total unavailable."""
    final, snapshot, increment = (F.col("semantics") == s for s in ("final", "snapshot", "increment"))
    per = rows.groupBy(*key).agg(
        F.min(F.when(final, F.col("amount"))).alias("__low"),
        F.max(F.when(final, F.col("amount"))).alias("__high"),
        F.max(F.when(snapshot, F.struct(order, "amount")))["amount"].alias("__last"),
        F.sum(F.when(increment, F.col("amount"))).alias("__sum"),
    )
    conflict = F.col("__low") != F.col("__high")
    total = F.when(~F.coalesce(conflict, F.lit(False)), F.coalesce("__low", "__last", "__sum"))
    basis = F.when(conflict, "conflict").when(F.col("__low").isNotNull(), "final").when(F.col("__last").isNotNull(), "snapshot").when(F.col("__sum").isNotNull(), "increments").otherwise("missing")
    return per.select(*key, total.alias("total"), basis.alias("basis"), F.when(total.isNull(), "unavailable").otherwise("known").alias("status"))


def coverage(records: DataFrame, kind: str, mapped: Column) -> DataFrame:
    """Native types with their total, mapped and unmapped records."""
    return records.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"))


def worst(rows: DataFrame, key: list[str], dimension: str, severity: list[str], value: str) -> DataFrame:
    """Per key: the worst value of each dimension's rows, then of all dimensions. severity: from best to worst."""
    rank = F.array_position(F.array(*map(F.lit, severity)), F.col(value))
    per = rows.withColumn("__rank", rank).groupBy(*key, dimension).agg(F.max("__rank").alias("__rank"))
    name = lambda c: F.element_at(F.array(*map(F.lit, severity)), c.cast("int"))
    return per.groupBy(*key).agg(F.max("__rank").alias("__rank"), F.count("*").alias("dimensions")).select(*key, name(F.col("__rank")).alias("overall"), "dimensions")


def request_count(events: DataFrame, attempt: str, request: str, scope: str) -> DataFrame:
    """Logical requests: each request id counts once for each scope it is seen in; rows without an id make it unavailable."""
    ids = events.groupBy(attempt, request).agg(F.count_distinct(scope).alias("__scopes"), F.count("*").alias("__rows"))
    per = ids.groupBy(attempt).agg(F.sum(F.when(F.col(request).isNotNull(), F.greatest(F.lit(1), F.col("__scopes")))).alias("requests"), F.coalesce(F.sum(F.when(F.col(request).isNull(), F.col("__rows"))), F.lit(0)).alias("unidentified"))
    return per.select(attempt, F.when(F.col("unidentified") == 0, F.col("requests")).alias("requests"), F.when(F.col("unidentified") > 0, "unavailable").otherwise("known").alias("status"))
