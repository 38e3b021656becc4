"""Measurements that are known or unavailable, never a bare null.

A measurement is a struct: status, value, numerator, denominator, numerator_unit, denominator_unit, reason
and exclusions, an array of (reason, count) in the order of the reasons. A denominator of 0 makes it
unavailable, with no rate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "The eligible denominator is empty."
_EXCLUSION = "struct<reason: string, count: bigint>"


def known(value: Column, unit: str) -> Column:
    return F.struct(F.lit("known").alias("status"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("reason"))


def unavailable(reason: str | Column, kind: str = "double") -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit("unavailable").alias("status"), F.lit(None).cast(kind).alias("value"), F.lit(None).cast("string").alias("unit"), reason.alias("reason"))


def or_unavailable(value: Column, dimension: str = "unavailable") -> Column:
    """A grouping dimension: missing becomes a group of its own."""
    return F.coalesce(value.cast("string"), F.lit(dimension))


def exclusions(**counts: Column) -> Column:
    """Counted reasons (underscores stand for dashes), without those that count nothing."""
    each = [F.struct(F.lit(k.replace("_", "-")).alias("reason"), v.cast("bigint").alias("count")) for k, v in sorted(counts.items())]
    made = F.array(*each) if each else F.array().cast(f"array<{_EXCLUSION}>")
    return F.filter(made, lambda x: x["count"] > 0)


def measurement(numerator: Column, denominator: Column, unit: str, denominator_unit: str | None = None, excluded: Column | None = None, rate: bool = True) -> Column:
    some = denominator > 0
    none = F.lit(None)
    return F.struct(
        F.when(some, "available").otherwise("unavailable").alias("status"),
        F.when(some, numerator).cast("double").alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        (F.try_divide(numerator, denominator) if rate else none).cast("double").alias("rate"),
        F.lit(unit).alias("numerator_unit"),
        F.lit(denominator_unit or unit).alias("denominator_unit"),
        F.when(~some, EMPTY).alias("reason"),
        (exclusions() if excluded is None else excluded).alias("exclusions"),
    )


def unavailable_measurement(denominator: Column, unit: str, reason: str) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit("unavailable").alias("status"),
        none.cast("double").alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        none.cast("double").alias("rate"),
        F.lit(unit).alias("numerator_unit"),
        F.lit(unit).alias("denominator_unit"),
        F.lit(reason).alias("reason"),
        exclusions().alias("exclusions"),
    )


def histogram_text(column: Column) -> Column:
    """Exclusions as ``reason=count`` joined by semicolons, for reports and comparisons between engines."""
    return F.array_join(F.transform(column, lambda x: F.concat(x["reason"], F.lit("="), x["count"].cast("string"))), ";")


def capability_gate(value: Column, capability: Column) -> Column:
    """A count under its adapter's capability: unsupported, or partial and zero, is unavailable."""
    unsupported = unavailable("The adapter does not expose this evidence.", "double")
    partial = unavailable("Partial capture cannot tell absence from zero.", "double")
    return F.when(capability == "unsupported", unsupported).when((capability == "partial") & (value == 0), partial).otherwise(known(value.cast("double"), "count"))
