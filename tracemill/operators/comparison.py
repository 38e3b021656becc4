"""Matched-pair comparison and its gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNMATCHED, AMBIGUOUS, MISSING, UNMEASURED = "unmatched-unit", "ambiguous-matched-unit", "match-dimension-unavailable", "measure-unavailable"


def matched_units(left: DataFrame, right: DataFrame, match_by: list[str], value: str) -> DataFrame:
    """A row for each key of either side: its values, and the reason if it is no pair of exactly one and one."""

    def side(df: DataFrame, name: str) -> DataFrame:
        whole = df.where(reduce(Column.__and__, (F.col(m).isNotNull() for m in match_by)))
        return whole.groupBy(*match_by).agg(F.count("*").alias(f"{name}_n"), F.min(value).alias(name))

    both = side(left, "left_value").join(side(right, "right_value"), match_by, "full")
    n, m = F.coalesce("left_value_n", F.lit(0)), F.coalesce("right_value_n", F.lit(0))
    reason = F.when((n == 0) | (m == 0), UNMATCHED).when((n > 1) | (m > 1), AMBIGUOUS).when(F.col("left_value").isNull() | F.col("right_value").isNull(), UNMEASURED)
    return both.select(*match_by, "left_value", "right_value", reason.alias("reason"))


def missing_dimensions(df: DataFrame, match_by: list[str]) -> Column:
    return F.count_if(reduce(Column.__or__, (F.col(m).isNull() for m in match_by)))


def matched_difference(left: DataFrame, right: DataFrame, match_by: list[str], value: str, recurrence_minimum: int = 2) -> DataFrame:
    """One row: the sum of right minus left over matched units, how many differ, and what was excluded, by reason."""
    units = matched_units(left, right, match_by, value)
    diff = F.when(F.col("reason").isNull(), F.col("right_value") - F.col("left_value"))
    missing = left.agg(missing_dimensions(left, match_by).alias("a")).crossJoin(right.agg(missing_dimensions(right, match_by).alias("b"))).select((F.col("a") + F.col("b")).alias(MISSING))
    total = units.agg(
        F.sum(diff).alias("difference"),
        F.count(diff).alias("matched_units"),
        F.count_if(diff != 0).alias("differing_units"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in (UNMATCHED, AMBIGUOUS, UNMEASURED)),
    )
    claim = F.when(F.col("matched_units") == 0, "unavailable").when(F.col("differing_units") == 0, "no-difference").when(F.col("differing_units") >= recurrence_minimum, "recurring-description").otherwise("case-study")
    return total.crossJoin(missing).withColumn("claim_status", claim)  # one row each


#: The candidates' fields that must agree, with the reason that a difference gives.
AGREEMENTS = {
    "task": "task-mismatch",
    "fixture": "fixture-mismatch",
    "assessment_mode": "assessment-mode-mismatch",
    "harness": "undeclared-harness-difference",
    "model": "undeclared-model-difference",
    "adapter_version": "adapter-version-mismatch",
}


def eligibility(pairs: DataFrame, declared: list[str]) -> DataFrame:
    """pairs: id and left, right structs with AGREEMENTS' fields and capabilities (array), required (array).

    Adds reasons (sorted) and status: supported, supported-with-caveats (only declared differences) or unsupported.
    """
    reasons, caveats = [], []
    for field, reason in AGREEMENTS.items():
        differs = ~F.col(f"left.{field}").eqNullSafe(F.col(f"right.{field}"))
        (caveats if field in declared else reasons).append(F.when(differs, F.lit(f"declared-{field}-difference" if field in declared else reason)))
    for side in ("left", "right"):
        lacks = F.size(F.array_except("required", F.coalesce(f"{side}.capabilities", F.array().cast("array<string>")))) > 0
        reasons.append(F.when(lacks, F.lit(f"{side}-capability-missing")))
    hard, soft = F.array_compact(F.array(*reasons)), F.array_compact(F.array(*caveats)) if caveats else F.array().cast("array<string>")
    status = F.when(F.size(hard) > 0, "unsupported").when(F.size(soft) > 0, "supported-with-caveats").otherwise("supported")
    return pairs.withColumn("reasons", F.array_sort(F.array_union(hard, soft))).withColumn("status", status)


def pair_key(left: Column, right: Column) -> Column:
    """The same key whichever side comes first."""
    return F.array_sort(F.array(left, right))
