"""Folds of adapters on records in odd orders: usage once, carried exits, chunks, channels, open calls."""

import json

import pytest

from tracemill import schemas
from tracemill.operators import folds


def native(spark, harness, docs, kind="session", attempt="a"):
    rows = [(attempt, attempt, "s", f"line:{k + 1}", harness, kind, d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in enumerate(docs)]
    return spark.createDataFrame(rows, "run_id string, attempt_id string, artifact_id string, locator string, harness string, kind string, doc string").select(*schemas.StructType.fromDDL(schemas.NATIVE).names)


def usage(message, **counts):
    return {"nativeType": "assistant", "message": {"message": {"id": message, "usage": counts}}}


def test_usage_counts_a_message_once(spark):
    docs = [usage("m1", input_tokens=5), usage("m1", input_tokens=7), usage("m2", input_tokens=-1), usage("m3", input_tokens=2.5), usage("m4", input_tokens="9"), usage(None, input_tokens=4), usage("m5", input_tokens=2**53), {"nativeType": "user", "message": {"message": {"id": "u", "usage": {}}}}, "{", None, {"nativeType": "assistant", "message": {"message": {"id": "m6", "usage": 3}}}, usage("m7", input_tokens=1)]
    got = {r["message_id"]: (r["input_tokens"], r["requests"], r["total_input_tokens"]) for r in folds.request_usage(native(spark, "agent-sdk", docs)).collect()}
    assert got == {"m1": (5, 1, 5), "m2": (None, 2, 5), "m3": (None, 3, 5), "m4": (None, 4, 5), "m5": (None, 5, 5), "m7": (1, 6, 6)}
    assert folds.request_usage(native(spark, "agent-sdk", docs, kind="hook")).count() == 0


def update(**fields):
    return {"kind": "notification", "method": "session/update", "payload": {"update": fields}}


def test_exits_are_carried_by_their_call(spark):
    docs = [
        update(sessionUpdate="tool_call_update", toolCallId="x", status="completed"),
        update(sessionUpdate="tool_call", toolCallId="x", rawInput={"a": 1}, _meta={"cognition.ai/inferenceToolName": "exec"}),
        update(sessionUpdate="tool_call_update", toolCallId="x", status="in_progress", _meta={"terminal_exit": {"exit_code": 3}}),
        update(sessionUpdate="tool_call_update", toolCallId="y", status="completed"),
        update(sessionUpdate="tool_call", toolCallId="x"),
        update(sessionUpdate="tool_call_update", toolCallId="x", status="failed", _meta={"cognition.ai/canceled": True}),
        update(sessionUpdate="tool_call_update", status="completed", _meta={"terminal_exit": {"exit_code": 9, "signal": "KILL"}}),
        update(sessionUpdate="tool_call_update", status="completed"),
    ]
    rows = sorted(folds.devin_calls(native(spark, "devin", docs)).collect(), key=lambda r: r["order_value"])
    assert [(r["order_value"], r["phase"], r["exit_code"], r["signal"], r["parent_id"], r["canceled"]) for r in rows] == [
        (1, "after", None, None, None, False),
        (2, "before", None, None, None, False),
        (4, "after", None, None, None, False),
        (5, "before", None, None, None, False),
        (6, "after", 3, None, "devin:2:tool_call", True),
        (7, "after", 9, "KILL", None, False),
        (8, "after", None, None, None, False),
    ]
    assert rows[1]["input_digest"].startswith("sha256:") and rows[1]["tool_name"] == "exec" and rows[3]["input_digest"] is None


def test_chunks_join_until_something_comes_between(spark):
    chunk = lambda who, text: update(sessionUpdate=f"{who}_message_chunk", content={"text": text})
    docs = [chunk("agent", "a"), chunk("agent", "b"), chunk("user", "c"), update(sessionUpdate="plan"), chunk("user", "d"), chunk("user", None), chunk("user", "e")]
    rows = sorted(folds.devin_messages(native(spark, "devin", docs)).collect(), key=lambda r: r["order_value"])
    assert [(r["speaker"], r["chunks"], r["text"]) for r in rows] == [("agent", 2, "ab"), ("user", 1, "c"), ("user", 3, "de")]


@pytest.mark.parametrize("known", [True, False])
def test_rest_wins_over_the_socket(spark, known):
    rec = lambda channel, id: {"channel": channel, "payload": {"id": id}} | ({"session_id": "c"} if known else {})
    docs = [rec("websocket-event", "e1"), rec("websocket-event", "e1"), rec("rest-event", "e2"), rec("websocket-event", "e2"), rec("rest-event", "e2"), rec("conversation-final", None), rec("websocket-event", None)]
    rows = sorted(folds.openhands_canonical(native(spark, "openhands", docs)).collect(), key=lambda r: r["locator"])
    if known:
        assert [r["canonical"] for r in rows] == [True, False, False, False, True, True, False]
        assert [r["reason"] for r in rows] == [None, folds.DUPLICATE, folds.NO_MAPPING, folds.DUPLICATE, None, None, folds.NO_MAPPING]
    else:
        assert {r["reason"] for r in rows} == {folds.NO_CONVERSATION}


def test_no_records(spark):
    none = native(spark, "x", [None])
    for fold in (folds.request_usage, folds.devin_calls, folds.devin_messages, folds.openhands_canonical):
        assert fold(none).count() == 0


def test_a_record_is_parsed_once(spark):
    from tracemill.operators import folds as of

    native = spark.range(3).selectExpr("'r' AS run_id", "'a' AS attempt_id", "'s' AS artifact_id", "'line:' || id AS locator", "'devin' AS harness", "'session' AS kind", "IF(id = 2, 'x', '{\"sequence\":1}') AS doc")
    rows = of._parsed(native, "devin").where((of._get("$.sequence", "bigint") == 1) & of._get("$.method").isNull())
    assert rows.count() == 2
    once = of._parsed(native, "devin")._jdf.queryExecution().optimizedPlan().toString().count("parseJson")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == once
