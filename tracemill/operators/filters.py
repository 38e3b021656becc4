"""Filters over the corpus: equality on fields, whole attempts, free text, facets, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arguments of a corpus query and the columns they filter; ``trial`` filters the trial, not the run.
FIELDS = {
    "run": "run_id",
    "attempt": "attempt_id",
    "task": "task_id",
    "fixture": "fixture_id",
    "trial": "trial_id",
    "model": "model_id",
    "provider": "model_provider",
    "harness": "harness_id",
    "assessment_mode": "assessment_mode",
    "terminal_state": "terminal_state",
    "failure_class": "failure_class",
    "qualification": "capture_qualification",
}


def query_corpus(index: DataFrame, verifier_status: str | None = None, **fields: object) -> DataFrame:
    """Index rows that equal every field given, and whose verifier statuses hold the one given."""
    unknown = fields.keys() - FIELDS.keys()
    if unknown:
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    tests = [F.col(FIELDS[k]) == v for k, v in fields.items() if v is not None]
    if verifier_status is not None:
        tests.append(F.array_contains("verifier_statuses", verifier_status))
    return index.where(reduce(Column.__and__, tests)) if tests else index


def keep_whole_attempts(judgments: DataFrame, case: Column, attempt: str) -> DataFrame:
    """All judgments of the attempts that have a matching case."""
    return judgments.join(judgments.where(case).select(attempt).distinct(), attempt, "left_semi")


def free_text(df: DataFrame, columns: list[str], q: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold q in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(q))))


def facet_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, option: every distinct value of each column, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("option")) for c in columns)))
    return df.select(each.alias("x")).select("x.facet", "x.option").where("option IS NOT NULL").distinct()


def matches_lists(df: DataFrame, lists: dict[str, list], confidence: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows whose fields are in the lists given; a null confidence fails any range."""
    tests = [F.col(k).isin(v) for k, v in lists.items() if v]
    tests += [F.col(confidence) >= least] if least is not None else []
    tests += [F.col(confidence) <= most] if most is not None else []
    return df.where(reduce(Column.__and__, tests)) if tests else df


def accepted_by_policy(kind: Column, confidence: Column, probability: Column) -> Column:
    """A choice is accepted from a confidence of 0.8, a yes or no from 0.4 off the middle."""
    return F.when(kind == "choice", confidence >= 0.8).otherwise(F.abs(probability - 0.5) >= 0.4)


def explicit_failure(a: Column) -> Column:
    """Whether a tool event's attributes (a map of strings) say that it failed."""
    get = lambda k: F.try_element_at(a, F.lit(k))
    status = F.lower(get("status"))
    said = (get("isError") == "true") | get("errorScope").isNotNull() | (get("hook") == "PostToolUseFailure") | status.isin("failed", "error", "errored")
    return F.coalesce(said, F.lit(False)) | F.coalesce(get("exitCode").try_cast("long") != 0, F.lit(False))


def compaction(family: Column, a: Column) -> Column:
    """Whether an event belongs to a context compaction."""
    names = [F.lower(F.coalesce(F.try_element_at(a, F.lit(k)), F.lit(""))) for k in ("hook", "subtype", "eventType", "method", "lifecycle")]
    return F.coalesce(family.isin("context", "lifecycle") & reduce(Column.__or__, (n.contains("compact") for n in names)), F.lit(False))
