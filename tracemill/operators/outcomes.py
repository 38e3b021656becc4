"""Outcomes of attempts: retained observations, verifier assertions, verified and reviewed rates, exact bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.availability import exclusions, measurement
from tracemill.operators.aggregation import grouped

NO_MODE = "Assessment mode evidence is missing."
NO_TERMINAL = "Terminal outcome evidence is missing."
NO_CAPTURE = "Capture qualification evidence was not supplied."
NO_WORKSPACE = "Terminal outcome does not reference a final workspace artifact."
LOST_WORKSPACE = "Terminal-referenced workspace outcome evidence is missing."
NO_MUTATION = "No normalized event explicitly identifies a mutation."
NO_ORDER = "Mutation and validation ordering is unknown or spans unrelated native-order domains."
#: Columns that a comparison's candidate and an attempt must agree in, missing values included.
BINDING = (
    "run_id", "manifest_digest", "task_id", "task_digest", "fixture_id", "fixture_digest", "model_id", "model_configuration_digest", "harness_id",
    "harness_version", "harness_configuration_digest", "assessment_mode", "capture_profile_digest", "budget_digest", "tool_policy_digest",
)


def _observation(id: str, text: Column, number: Column, unit: str, reason: Column) -> Column:
    """An observation is unavailable exactly if there is a reason."""
    known = reason.isNull()
    return F.struct(
        F.lit(id).alias("extractor_id"), F.when(known, "known").otherwise("unavailable").alias("status"), F.when(known, text).alias("str"),
        F.when(known, number).cast("double").alias("num"), F.when(known, F.lit(unit)).alias("unit"), reason.alias("reason"),
    )


def outcome_observations(attempts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """attempts: attempt_id, assessment_mode, terminal_state, capture_qualification (null: no evidence); workspaces:
    attempt_id, workspace_id, retained, for each final workspace that a terminal record names. Four observations an attempt."""
    own = workspaces.groupBy("attempt_id").agg(F.count("*").alias("named"), F.count_distinct(F.when(F.col("retained"), F.col("workspace_id"))).alias("found"))
    rows = attempts.join(own, "attempt_id", "left")
    none = F.lit(None).cast("string")
    text = lambda id, column, unit, why, missing: _observation(id, F.col(column), F.lit(None), unit, F.when(missing, why))
    lost = F.when(F.coalesce("named", F.lit(0)) == 0, NO_WORKSPACE).when(F.col("found") == 0, LOST_WORKSPACE)
    each = F.array(
        text("assessment-mode", "assessment_mode", "mode", NO_MODE, F.coalesce("assessment_mode", F.lit("unknown")) == "unknown"),
        text("terminal-state", "terminal_state", "state", NO_TERMINAL, F.col("terminal_state").isNull()),
        text("capture-qualification", "capture_qualification", "qualification", NO_CAPTURE, F.col("capture_qualification").isNull()),
        _observation("workspace-outcome-count", none, F.col("found"), "workspace-outcomes", lost),
    )
    return rows.select("attempt_id", F.explode(each).alias("x")).select("attempt_id", "x.*")


def verifier_observations(attempts: DataFrame, verifiers: DataFrame) -> DataFrame:
    """verifiers: attempt_id, assertions (array of id and status). An observation for each assertion of a verified attempt."""
    rows = verifiers.join(attempts.where("assessment_mode = 'verified'").select("attempt_id"), "attempt_id", "left_semi")
    said = rows.select("attempt_id", F.explode("assertions").alias("a")).where("a.id IS NOT NULL AND a.status IS NOT NULL")
    name = F.concat(F.lit("verifier-assertion-"), F.substring(F.sha2("a.id", 256), 1, 16))
    return said.select("attempt_id", name.alias("extractor_id"), F.lit("known").alias("status"), F.col("a.status").alias("str"), F.lit("assertion-status").alias("unit"))


def validation_after_mutation(events: DataFrame, capability: Column) -> DataFrame:
    """events: attempt_id, kind (mutation, validation or another), order_value, order_domain. Per attempt, whether a
    validation follows the last mutation; known only if all of them are ordered in one domain. capability: by attempt."""
    told = F.col("kind").isin("mutation", "validation")
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("order_value")))
    per = events.groupBy("attempt_id").agg(
        F.first(capability).alias("capability"), F.count_if(F.col("kind") == "mutation").alias("mutations"), last("mutation").alias("mutated"), last("validation").alias("validated"),
        F.count_if(told & (F.col("order_value").isNull() | F.col("order_domain").isNull())).alias("unordered"), F.count_distinct(F.when(told, F.col("order_domain"))).alias("domains"),
    )
    reason = F.when(F.col("capability").isin("unsupported", "partial"), F.concat(F.lit("Required capability is "), "capability", F.lit(".")))
    reason = reason.when(F.col("mutations") == 0, NO_MUTATION).when((F.col("unordered") > 0) | (F.col("domains") != 1), NO_ORDER)
    value = F.coalesce(F.col("validated") > F.col("mutated"), F.lit(False))
    rows = per.withColumn("reason", reason)
    return rows.select("attempt_id", F.when(F.col("reason").isNull(), "known").otherwise("unavailable").alias("status"), F.when(F.col("reason").isNull(), value).alias("value"), "reason")


def _long(wide: DataFrame, dims: list[str], names: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("measurement")) for k in names)))
    return wide.select(*dims, each.alias("x")).select(*dims, "x.metric", "x.measurement")


def verified_metrics(attempts: DataFrame, dims: list[str]) -> DataFrame:
    """attempts: selected, assessment_mode, verifier_statuses (array), observed. The rates of verifiers' passes, over attempts
    with one verdict, and of attempts with a set of observations."""
    s, mode, said = F.col("selected"), F.coalesce("assessment_mode", F.lit("unknown")), F.coalesce("verifier_statuses", F.array().cast("array<string>"))
    one = F.when(F.size(said) == 1, F.try_element_at(said, F.lit(1)))
    verified, other = s & (mode == "verified") & F.coalesce(one.isin("passed", "failed"), F.lit(False)), s & (mode != "verified")
    n, n_verified, n_other = F.count_if(s), F.count_if(verified), F.count_if(other)
    made = {
        "verifier-pass-rate": measurement(F.count_if(verified & (one == "passed")), n_verified, "attempt", "verified-attempt", exclusions(observational_or_unknown_assessment_mode=n_other, verifier_outcome_unavailable_or_infrastructure=n - n_other - n_verified)),
        "structural-observation-set-availability-rate": measurement(F.count_if(s & F.col("observed")), n, "attempt", excluded=exclusions(observation_set_missing=F.count_if(s & ~F.col("observed")))),
    }
    return _long(grouped(attempts, dims).groupBy(*dims).agg(*(v.alias(k) for k, v in made.items())), dims, list(made))


def review_metrics(assertions: DataFrame, dims: list[str]) -> DataFrame:
    """assertions: abstained, outcome, disputed (review_outcomes' rows). Abstention, confirmation over reviewed ones, and
    unresolved and disputed reviews."""
    outcome, n = F.col("outcome"), F.count("*")
    reviewed = F.count_if(outcome.isin("confirmed", "rejected", "unresolved"))
    made = {
        "assertion-abstention-rate": measurement(F.count_if("abstained"), n, "assertion"),
        "reviewed-assertion-confirmed-rate": measurement(F.count_if(outcome == "confirmed"), reviewed, "reviewed-assertion", excluded=exclusions(judge_abstained=F.count_if(outcome == "judge-abstained"), unreviewed=F.count_if(outcome == "unreviewed"))),
        "review-unresolved-rate": measurement(F.count_if(outcome.isin("unresolved", "unreviewed", "judge-abstained")), n, "assertion"),
        "review-disputed-rate": measurement(F.count_if("disputed"), n, "assertion"),
    }
    return _long(grouped(assertions, dims).groupBy(*dims).agg(*(v.alias(k) for k, v in made.items())), dims, list(made))


def bound_candidates(candidates: DataFrame, attempts: DataFrame) -> DataFrame:
    """candidates: candidate, BINDING, adapter_version, capability_profile; attempts: attempt_id and the same, the profile as
    canonical JSON. The attempts that each candidate binds: all columns agree, and the attempt has a profile."""
    theirs = attempts.where("capability_profile IS NOT NULL").select("attempt_id", *(F.col(c).alias(f"__{c}") for c in (*BINDING, "adapter_version", "capability_profile")))
    same = F.lit(True)
    for c in (*BINDING, "adapter_version", "capability_profile"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return candidates.join(theirs, same).select("candidate", "attempt_id")


def recording_grain(attempts: DataFrame, arm: str, measures: list[str]) -> DataFrame:
    """Per arm and measure: the rounded mean over the attempts that have it; null where none has."""
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("long")
    per = attempts.groupBy(arm).agg(*(mean(m).alias(m) for m in measures))
    return per.select(arm, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("mean")) for m in measures))).alias("x")).select(arm, "x.*")


def largest_types(counts: DataFrame, attempts: DataFrame, arm: str, k: int = 3) -> DataFrame:
    """counts: attempt_id, type, n. Per arm, its k most frequent types and their rounded number for an attempt of the arm."""
    lanes = attempts.groupBy(arm).agg(F.count("*").alias("lanes"))
    per = counts.join(attempts.select("attempt_id", arm), "attempt_id").groupBy(arm, "type").agg(F.sum("n").alias("total"))
    ranked = per.withColumn("rank", F.row_number().over(W.partitionBy(arm).orderBy(F.desc("total"), "type"))).where(F.col("rank") <= k)
    return ranked.join(lanes, arm).select(arm, "rank", "type", F.floor(F.col("total") / F.col("lanes") + 0.5).cast("long").alias("mean"))


def known_changes_between(events: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """events: by, id, domain, value, time (null: unknown), change. pairs: by, from_id, to_id, of one domain each.
    Adds changes: how many lie strictly between, by value in the pair's domain and by time in others; null if a change
    can't be compared with an end of the pair: equal values or times, or a time that is needed and unknown.

    Every event gets the numbers of changes before it from windows, so no pair meets the changes one by one.
    """
    change = F.col("change").cast("long")
    domain, whole = W.partitionBy(by, "domain"), W.partitionBy(by)
    before = lambda w, order: w.orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    at = lambda w, order: w.orderBy(order).rangeBetween(0, 0)
    total = lambda w: F.coalesce(F.sum(change).over(w), F.lit(0))
    timed = F.when(F.col("time").isNotNull(), F.col("change")).cast("long")
    untimed = F.when(F.col("time").isNull(), change).otherwise(0)
    rows = events.select(
        by, "id", "domain", "time", change.alias("own"), total(before(domain, "value")).alias("native"), (total(at(domain, "value")) - change).alias("native_ties"),
        (F.coalesce(F.sum(timed).over(before(whole, "time")), F.lit(0)) - F.coalesce(F.sum(timed).over(before(domain, "time")), F.lit(0))).alias("elsewhere"),
        (F.coalesce(F.sum(timed).over(at(whole, "time")), F.lit(0)) - F.coalesce(F.sum(timed).over(at(domain, "time")), F.lit(0))).alias("ties"),
        (total(whole) - total(domain)).alias("others"), (F.sum(untimed).over(whole) - F.sum(untimed).over(domain)).alias("others_untimed"),
    )
    end = lambda name: rows.select(F.col(by).alias(f"__{name}_by"), F.col("id").alias(f"{name}_id"), F.struct(*[c for c in rows.columns if c != by]).alias(name))
    joined = pairs.join(end("from").withColumnRenamed("from_id", "__f"), (F.col("__from_by") == pairs[by]) & (pairs["from_id"] == F.col("__f")))
    joined = joined.join(end("to").withColumnRenamed("to_id", "__t"), (F.col("__to_by") == F.col(by)) & (F.col("to_id") == F.col("__t")))
    ties = (F.col("from.native_ties") > 0) | (F.col("to.native_ties") > 0)
    elsewhere = (F.col("from.others") > 0) & (F.col("from.time").isNull() | F.col("to.time").isNull() | (F.col("from.others_untimed") > 0) | (F.col("from.ties") > 0) | (F.col("to.ties") > 0))
    native = F.col("to.native") - F.col("from.native") - F.col("from.own")
    timed_between = F.when(F.col("from.others") > 0, F.col("to.elsewhere") - F.col("from.elsewhere")).otherwise(0)
    found = F.greatest(F.lit(0), native) + F.greatest(F.lit(0), timed_between)
    return joined.select(by, "from_id", "to_id", F.when(~(ties | elsewhere), found).alias("changes"))
