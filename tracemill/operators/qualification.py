"""How good a capture is, and how an attempt ended: reasons by dimension, terminal classes, claim checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.filters import accepted_by_policy

DIMENSIONS = ("attemptIdentity", "semanticEvidence", "hooks", "telemetry", "workspace", "verifier", "terminal", "sharing")
SEVERITY = ("qualified", "unsupported", "gap", "unqualified")

# fixed values: code, dimension, severity, and the flag of an attempt's evidence that raises it
REASONS = """
MANIFEST_INVALID attemptIdentity unqualified manifest_invalid
ATTEMPT_IDENTITY_INVALID attemptIdentity unqualified identity_invalid
ARTIFACT_INTEGRITY_INVALID semanticEvidence unqualified digest_differs
ARTIFACT_TOO_LARGE semanticEvidence gap artifact_too_large
NATIVE_JSONL_EMPTY semanticEvidence unqualified session_empty
NATIVE_JSONL_MALFORMED semanticEvidence unqualified session_malformed
SESSION_EVIDENCE_MISSING semanticEvidence unqualified session_missing
SESSION_IDENTITY_MISSING semanticEvidence gap session_unnamed
SESSION_RECORD_IDENTITY_MISMATCH semanticEvidence unqualified session_mismatch
HOOK_EVIDENCE_MISSING hooks gap hooks_missing
HOOK_SUPPORTED_BUT_MISSING hooks unqualified hooks_supported_but_missing
HOOK_UNSUPPORTED_BY_PINNED_SDK hooks unsupported hooks_unsupported
HOOK_CAPTURE_WARNING hooks gap hooks_warning
TELEMETRY_EVIDENCE_MISSING telemetry gap telemetry_missing
TELEMETRY_RECEIPT_MISSING telemetry gap telemetry_receipt_missing
TELEMETRY_UNSUPPORTED_BY_PINNED_RUNTIME telemetry unsupported telemetry_unsupported
WORKSPACE_EVIDENCE_MISSING workspace gap workspace_missing
WORKSPACE_PATCH_UNUSABLE workspace unqualified patch_unusable
WORKSPACE_ENTRIES_OMITTED workspace gap workspace_omitted
VERIFIER_EVIDENCE_MISSING verifier gap verifier_missing
VERIFIER_RESULT_ERROR verifier gap verifier_error
VERIFIER_RESULT_NOT_RUN verifier gap verifier_not_run
TERMINAL_CLASSIFICATION_INVALID terminal unqualified terminal_invalid
INFRASTRUCTURE_FAILURE_MISCLASSIFIED_AS_TASK terminal unqualified failure_misclassified
SHARING_CLASSIFICATION_UNKNOWN sharing gap sharing_unknown
CAPTURE_REPORT_MISSING semanticEvidence gap report_missing
CAPTURE_REPORT_CONTRADICTS_SOURCE semanticEvidence unqualified report_contradicts
EVENT_LOG_COMPLETENESS_UNPROVEN semanticEvidence gap log_incomplete
"""


def reasons(attempts: DataFrame) -> DataFrame:
    """attempts: attempt_id and the flags of REASONS that are known (a null or absent flag raises nothing)."""
    raised = [
        F.when(F.coalesce(F.col(flag), F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity")))
        for code, dimension, severity, flag in (line.split() for line in REASONS.strip().splitlines())
        if flag in attempts.columns
    ]
    return attempts.select("attempt_id", F.explode(F.array_compact(F.array(*raised))).alias("r")).select("attempt_id", "r.code", "r.dimension", "r.severity")


def qualify(attempts: DataFrame) -> DataFrame:
    """attempt_id, status, semantic_usable and the reason codes: the worst severity of each dimension decides."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    per = reasons(attempts).groupBy("attempt_id").agg(F.max(rank).alias("worst"), F.array_sort(F.collect_set("code")).alias("codes"), F.bool_or((F.col("severity") == "unqualified") & F.col("dimension").isin("attemptIdentity", "semanticEvidence", "hooks")).alias("unusable"))
    rows = attempts.select("attempt_id").join(per, "attempt_id", "left")
    status = F.when(F.col("worst") == 4, "unqualified").when(F.col("worst") == 3, "qualified-with-gaps").otherwise("qualified")
    return rows.select("attempt_id", status.alias("status"), (~F.coalesce("unusable", F.lit(False))).alias("semantic_usable"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def terminal(harness: Column, stop: Column, verifier: Column, workspace_retained: Column) -> Column:
    """State, failure class and source of an attempt's end.

    harness: completed, failed, stopped, interrupted; stop: policy or budget; verifier: passed, failed, error,
    not-run or null (observational). A failure that the harness reports isn't the task's without a verifier.
    """

    def end(state: str, failure: str, source: str) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(failure).alias("failure_class"), F.lit(source).alias("source"))

    finished = F.when(F.coalesce(workspace_retained, F.lit(False)), end("completed", "none", "runner")).otherwise(end("failed", "infrastructure", "workspace"))
    return (
        F.when(harness == "failed", end("failed", "infrastructure", "harness"))
        .when((harness == "stopped") & (stop == "policy"), end("stopped", "policy", "harness"))
        .when((harness == "stopped") & (stop == "budget"), end("stopped", "budget", "harness"))
        .when(harness == "stopped", end("failed", "infrastructure", "harness"))
        .when(harness == "interrupted", end("interrupted", "infrastructure", "harness"))
        .when(verifier == "failed", end("failed", "task", "verifier"))
        .when(verifier.isin("error", "not-run"), end("failed", "infrastructure", "verifier"))
        .when(verifier.isNull() | (verifier == "passed"), finished)
    )


def claim_checks(answers: DataFrame) -> DataFrame:
    """answers: assertion, claim, status, label, confidence. Per assertion: claims, checked, supported and flagged ones."""
    done = F.col("status") == "completed"
    accepted = F.coalesce(accepted_by_policy(F.lit("choice"), F.col("confidence"), F.lit(None).cast("double")), F.lit(False))
    supported = F.coalesce((F.col("label") == "supported") & accepted, F.lit(False))
    return answers.groupBy("assertion").agg(F.count("*").alias("claims"), F.count_if(done).alias("checked"), F.count_if(~done).alias("failed_decisions"), F.count_if(done & supported).alias("supported"), F.count_if(done & ~supported).alias("flagged"))
