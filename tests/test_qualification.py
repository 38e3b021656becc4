from pyspark.sql import functions as F

from tracemill.operators import qualification


def test_reasons(spark):
    rows = spark.createDataFrame([("a", False, None, False), ("b", True, True, False), ("c", False, True, True)], "attempt_id string, hooks_unsupported boolean, verifier_missing boolean, session_missing boolean")
    got = {r["attempt_id"]: (r["status"], r["semantic_usable"], r["codes"]) for r in qualification.qualify(rows).collect()}
    assert got == {
        "a": ("qualified", True, []),
        "b": ("qualified-with-gaps", True, ["HOOK_UNSUPPORTED_BY_PINNED_SDK", "VERIFIER_EVIDENCE_MISSING"]),
        "c": ("unqualified", False, ["SESSION_EVIDENCE_MISSING", "VERIFIER_EVIDENCE_MISSING"]),
    }


def test_terminal(spark):
    rows = [("completed", None, "passed", True), ("completed", None, "passed", False), ("completed", None, "failed", True), ("completed", None, "error", True), ("failed", None, "passed", True), ("stopped", "budget", None, True), ("stopped", None, None, True), ("interrupted", None, None, True), ("completed", None, None, True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, h string, s string, v string, w boolean")
    got = [tuple(r["t"]) for r in df.select("k", qualification.terminal(F.col("h"), F.col("s"), F.col("v"), F.col("w")).alias("t")).orderBy("k").collect()]
    assert got == [("completed", "none", "runner"), ("failed", "infrastructure", "workspace"), ("failed", "task", "verifier"), ("failed", "infrastructure", "verifier"), ("failed", "infrastructure", "harness"), ("stopped", "budget", "harness"), ("failed", "infrastructure", "harness"), ("interrupted", "infrastructure", "harness"), ("completed", "none", "runner")]


def test_claim_checks(spark):
    rows = spark.createDataFrame([("a", "1", "completed", "supported", 0.9), ("a", "2", "completed", "supported", 0.5), ("a", "3", "failed", None, None)], "assertion string, claim string, status string, label string, confidence double")
    assert qualification.claim_checks(rows).first()[1:] == (3, 2, 1, 1, 1)
