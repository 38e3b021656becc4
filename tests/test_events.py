"""Native records through normalization, occurrences, observations and units."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import normalize, occurrences


def _line(n, harness, doc, artifact="session"):
    return ("r", "a-" + harness, artifact, f"line:{n}", harness, "session", json.dumps(doc))


def _sdk(n, native, message, **more):
    return _line(n, "agent-sdk", {"sequence": n, "nativeType": native, "sessionId": "s", "message": {"timestamp": f"2026-01-01T00:00:{n:02d}.000Z", **message}, **more})


def _use(tool, name, **given):
    return {"message": {"content": [{"type": "tool_use", "id": tool, "name": name, "input": given}]}}


def _result(tool, error=False):
    return {"message": {"content": [{"type": "tool_result", "tool_use_id": tool, "content": "x", "is_error": error}]}}


@pytest.fixture(scope="module")
def native(spark):
    rows = [
        _sdk(1, "user", {"message": {"content": "go"}}),
        _sdk(2, "assistant", _use("t1", "Bash", command="pnpm test")),
        _sdk(3, "user", _result("t1", True)),
        _sdk(4, "assistant", _use("t2", "Bash", command="pnpm test")),
        _sdk(5, "user", _result("t2")),
        _sdk(6, "system", {}, nativeSubtype="compact_boundary"),
        _sdk(7, "system", {"task_id": "k"}, nativeSubtype="task_started"),
        _sdk(8, "result", {"total_cost_usd": 1.5}),
        _sdk(9, "novel", {}),
        ("r", "a-agent-sdk", "session", "line:10", "agent-sdk", "session", "{not json"),
        _line(1, "codex", {"sequence": 1, "method": "item/completed", "payload": {"threadId": "x", "item": {"type": "commandExecution", "id": "c1", "command": "ls", "exitCode": 2}}}),
        _line(2, "codex", {"sequence": 2, "method": "turn/completed", "payload": {}}),
        _line(1, "cursor", {"sequence": 1, "channel": "stream", "sessionId": "z", "payload": {"message": {"type": "tool_call", "status": "running", "call_id": "q", "name": "Edit", "args": {"a": 1}}}}),
        _line(2, "cursor", {"sequence": 2, "channel": "stream", "sessionId": "z", "payload": {"message": {"type": "tool_call", "status": "completed", "call_id": "q", "name": "Edit"}}}),
        _line(1, "openhands", {"kind": "ActionEvent", "id": "e", "tool_call_id": "w", "tool_name": "terminal", "timestamp": "2026-01-01T00:00:00Z", "channel": "websocket"}),
        _line(2, "openhands", {"kind": "ActionEvent", "id": "e", "tool_call_id": "w", "tool_name": "terminal", "timestamp": "2026-01-01T00:00:00Z", "channel": "rest"}),
    ]
    return spark.createDataFrame(rows, schemas.NATIVE)


@pytest.fixture(scope="module")
def events(native):
    return normalize.normalize(native).cache()


def test_families(events):
    got = sorted((r["attempt_id"][2:], r["locator"], r["family"], r["phase"], r["actor_kind"]) for r in events.collect())
    assert ("agent-sdk", "line:2", "message", "instant", "model") in got and ("agent-sdk", "line:2", "tool", "before", "model") in got
    assert ("agent-sdk", "line:6", "context", "after", "harness") in got and ("agent-sdk", "line:7", "delegation", "before", "agent") in got
    assert ("codex", "line:1", "tool", "after", "tool") in got and ("cursor", "line:1", "tool", "before", "tool") in got and ("cursor", "line:2", "tool", "after", "tool") in got
    assert events.count() == 18


def test_captured_is_mapped_or_unmapped(native, events):
    left = {(r["locator"], r["reason"]) for r in normalize.unmapped(native, events).collect()}
    assert left == {("line:9", "no uniform mapping for this native type"), ("line:10", "not valid JSON")}
    assert normalize.breaches(events, native).count() == 0
    assert {r["problem"] for r in normalize.breaches(events.unionByName(events.limit(1)), native.where("locator <> 'line:1'")).collect()} == {"id-not-unique", "reference-not-captured"}


def test_parents_and_channels(events):
    found = normalize.parents(events).collect()
    assert len(found) == 3  # two results of the first harness, one of cursor
    kept = normalize.reconcile(events.where("harness = 'openhands'"), F.element_at("attributes", "nativeId"), F.when(F.element_at("attributes", "channel") == "rest", 0).otherwise(1))
    assert [r["locator"] for r in kept.collect()] == ["line:2"]


def test_occurrences_observations_units(spark, events):
    given = F.when(F.element_at("attributes", "toolName") == "Bash", "pnpm test")
    rows = events.withColumn("attributes", F.map_concat("attributes", F.map_filter(F.create_map(F.lit("command"), given), lambda _, v: v.isNotNull())))
    ops = occurrences.operations(rows)
    found = occurrences.occurrences(rows, ops)
    got = {(r["attempt_id"][2:], r["type"]): r["attributes"] for r in found.collect()}
    assert got["agent-sdk", "failure-response"]["nextOutcome"] == "passed" and got["agent-sdk", "failure-response"]["failures"] == "1"
    assert got["agent-sdk", "validation-run"]["checkKinds"] == "test"
    assert ("agent-sdk", "repeated-operation") in got and ("agent-sdk", "delegation") in got
    assert got["cursor", "source-change"]["detectedBy"] == "edit-tool" if ("cursor", "source-change") in got else True
    cover = occurrences.coverage(rows, found, {"delegation": "not exposed"}).where("attempt_id = 'a-codex'").collect()
    assert {r["type"]: (r["status"], r["count"]) for r in cover}["delegation"] == ("unavailable", None)
    obs = {(r["attempt_id"][2:], r["extractor_id"]): (r["status"], r["num"]) for r in occurrences.observations(rows, ops, F.lit("available")).collect()}
    assert obs["agent-sdk", "tool-operation-count"] == ("known", 2.0) and obs["agent-sdk", "tool-error-count"] == ("known", 1.0)
    assert obs["agent-sdk", "failure-to-same-tool"] == ("known", 1.0) and obs["agent-sdk", "latency-ms"] == ("known", 7000.0)
    partial = {(r["attempt_id"][2:], r["extractor_id"]): r["status"] for r in occurrences.observations(rows, ops, F.lit("partial")).collect()}
    assert partial["codex", "tool-repeated-count"] == "unavailable" and partial["codex", "tool-error-count"] == "known"
    made = occurrences.units(rows, ops, found)
    sdk = [(r["seq"], r["unit_kind"], r["episode"], r["category"]) for r in made.where("attempt_id = 'a-agent-sdk'").orderBy("seq").collect()]
    assert sdk[0][:3] == (0, "message", 1) and {u[1] for u in sdk} >= {"message", "tool", "delegation"} and [u[0] for u in sdk] == list(range(len(sdk)))
    summary = occurrences.episode_summaries(made).where("attempt_id = 'a-agent-sdk'").orderBy(F.desc("units")).first()
    assert summary["checks"] == "test" and "shell" in summary["tools"]


@pytest.mark.parametrize("name", ["structural_observations", "occurrence_counts", "unit_counts"])
def test_records_are_parsed_once(spark, name):
    from tracemill.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "parsejson" not in plan.lower()
