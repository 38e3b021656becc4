"""Rewriting inside a string: order, overlaps, marks that aren't read again; the scan's checks one by one."""

import json
import random

import pytest

from tracemill.functions import exports
from tracemill.functions.exports import Rules, failures, rewrite


def one(text, **rules):
    return rewrite(text, Rules(**rules))[0]


def test_overlapping_values_longest_first():
    assert one("xabcdefy zab", values=("abcd", "cdef", "zab")) == "x[REDACTED_SECRET]efy [REDACTED_SECRET]"
    assert one("zabcd", values=("zab", "abcd")) == "z[REDACTED_SECRET]"
    assert one("aaaaa", values=("aa",)) == "[REDACTED_SECRET][REDACTED_SECRET]a"
    assert rewrite("aaaaa", Rules(values=("aa", "")))[1]["redacted_secret"] == 2


def test_what_replaces_a_string_is_never_read_again():
    assert one("key abcdefgh", values=("abcdefgh", "SECRET", "RED")) == "key [REDACTED_SECRET]"
    assert one("run-00001 run-00002", correlations=(("run-00001", "run-00002"), ("run-00002", "run-00001"))) == "run-00002 run-00001"
    assert one("has run-00001-key inside", values=("run-00001-key",), correlations=(("run-00001", "ref-1"),)) == "has [REDACTED_SECRET] inside"


def test_short_correlations_are_rewritten_as_a_whole_text_only():
    rules = {"correlations": (("r1", "ref-a"),)}
    assert one("r1", **rules) == "ref-a" and one("r1 r1", **rules) == "r1 r1"
    assert one("longer-than-eight", correlations=(("longer-than-eight", "x"),), in_text=False) == "x"
    assert one("a longer-than-eight", correlations=(("longer-than-eight", "x"),), in_text=False) == "a longer-than-eight"


def test_secrets_paths_and_users_follow_in_order():
    text = "token=abcdefgh12345 at /home/me/x owner: 'me' user=\\\"me\\\" login=me C:\\a\\b // no"
    got, counts = rewrite(text, Rules())
    assert got == "token=[REDACTED_SECRET] at [LOCAL_PATH] owner: '[LOCAL_USER]' user=\\\"[LOCAL_USER]\\\" login=[LOCAL_USER] [LOCAL_PATH] // no"
    assert counts == {"redacted_secret": 1, "rewritten_correlation": 0, "redacted_local_identifier": 5, "truncated": 0}
    assert rewrite(got, Rules())[0] == got and not failures(got, Rules())
    assert one("me", identifiers=("me",)) == "[LOCAL_USER]" and one("me too", identifiers=("me",)) == "me too"


def test_lengths_are_bytes():
    assert one("aé日😀", max_bytes=9) == "aé日" and one("aé日😀", max_bytes=10) == "aé日😀"
    assert one("é", max_bytes=1) == "" and one(None, max_bytes=1) is None and one("", max_bytes=0) == ""


def test_spans_against_replacing_one_value_after_the_other():
    rnd = random.Random(1)
    for _ in range(300):
        values = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(6)}
        text = "".join(rnd.choice("abc ") for _ in range(60))
        want = text
        for v in sorted(values, key=lambda v: (-len(v), v)):
            want = want.replace(v, "[REDACTED_SECRET]")
        assert one(text, values=tuple(values)) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ({"a": "nothing"}, []),
        ({"type": "reasoning"}, []),
        ({"type": "reasoning", "Encrypted-Content": "x"}, ["codex-reasoning", "pi-reasoning"]),
        ({"method": "item/reasoning/textDelta", "params": {"delta": "x"}}, ["codex-reasoning"]),
        ({"method": "item/reasoning/textDelta", "params": {"id": "x"}}, []),
        ({"a": [json.dumps({"channel": "analysis", "text": "x"})]}, ["codex-reasoning"]),
        ({"a": json.dumps({"thought": True, "text": "x"})}, []),
        ({"type": "thinking_start", "text": "x"}, ["pi-reasoning"]),
        ({"text_signature": "x"}, ["hidden-field", "pi-reasoning"]),
        ({"sessionUpdate": "agent_thought_chunk", "content": {}}, ["devin-thought"]),
        ({"type": "redacted_thinking", "id": "x"}, []),
        ({"type": "redacted_thinking", "data": "x"}, ["factory-reasoning"]),
        ({"signature": "x"}, []),
        ({"schemaVersion": "any.factory-runtime/v1", "inner": {"signature": "x"}}, ["factory-reasoning"]),
        ({"source": "any-factory-client", "inner": [{"signature": "x"}]}, ["factory-reasoning"]),
        ({"source": "factory", "inner": [{"signature": "x"}]}, []),
        ({"raw": "{broken thinkingText"}, ["factory-reasoning"]),
        ({"raw": json.dumps({"openaiReasoningId": "x"})}, ["factory-reasoning"]),
        ({"source": ["x"], "api_key": "value"}, ["secret"]),
        ({"api_key": "[REDACTED_SECRET]", "owner": "[LOCAL_USER]"}, []),
        ({"/home/x": "user=me"}, ["local-path", "local-identifier"]),
    ],
)
def test_checks_of_json(value, want):
    assert failures(json.dumps(value), Rules(), "application/json") == want
    assert failures("{}\n\n" + json.dumps(value) + "\n", Rules(), "application/x-ndjson") == want


def test_checks_of_texts():
    rules = Rules(values=("hidden value",), correlations=(("run-00001", "ref-1"), ("short", "x")))
    assert failures("the hidden value of run-00001, short", rules) == ["sensitive-value", "correlation"]
    assert failures("{", Rules(), "application/json") == ["unreadable"] and failures(None, rules) == []
    with pytest.raises(ValueError):
        Rules(values=("x" * (exports.DECLARED_BYTES + 1),))


def test_columns(spark):
    df = spark.createDataFrame([(1, "a sensitive-word here"), (2, None)], "id long, text string")
    rules = Rules(values=("sensitive-word",))
    out = exports.rewritten(df, "text", rules).orderBy("id").collect()
    assert [r["text"] for r in out] == ["a [REDACTED_SECRET] here", None] and out[0]["actions"]["redacted_secret"] == 1
    exports.assert_clean(exports.rewritten(df, "text", rules), "text", rules)
    with pytest.raises(ValueError, match="sensitive-value"):
        exports.assert_clean(df, "text", rules)
