"""An answer's faults one by one."""

import json

import pytest

from tracemill.operators import answers


def cite(event="e1", **more):
    return {"eventId": event, "nativeReference": {"artifactId": "a", "recordLocator": "line:1"}} | more


def answer(**fields):
    judgment = {
        "disposition": "assessed", "assessment": "mixed", "confidence": {"value": 0.5, "scale": answers.SCALE}, "reason": None, "missingEvidenceCapability": None, "rationale": "r",
        "alternativeExplanation": "a", "citations": [cite()], "claims": [{"id": "1", "text": "t", "citations": [cite()], "workspace": None}],
    }
    return {"judgment": judgment | fields}


CLAIM = {"id": "1", "text": "t", "citations": [cite()], "workspace": None}
ABSTAINED = {"disposition": "abstained", "assessment": None, "confidence": None, "reason": "none", "claims": []}
CASES = [
    (answer(), []),
    (answer(confidence={"value": 1, "scale": answers.SCALE}), []),
    (answer(**ABSTAINED), []),
    (answer(**ABSTAINED, missingEvidenceCapability="family:tool"), []),
    (answer(**ABSTAINED, missingEvidenceCapability="family:x"), ["missingEvidenceCapability"]),
    (answer(**ABSTAINED | {"reason": "  "}), ["reason"]),
    (answer(disposition="other"), ["disposition"]),
    (answer(confidence={"value": "0.5", "scale": answers.SCALE}), ["confidence"]),
    (answer(confidence={"value": 0.5}), ["confidence"]),
    (answer(confidence={"value": 1.01, "scale": answers.SCALE}), ["confidence"]),
    (answer(reason="x"), ["reason"]),
    (answer(rationale="x" * 8193), ["rationale"]),
    (answer(rationale=3), ["rationale"]),
    (answer(citations=None), ["citations"]),
    (answer(citations=[cite("e9")]), ["citations[0]"]),
    (answer(citations=[cite(), cite("e2"), cite()]), ["citations[2]"]),
    (answer(citations=[cite(more=1)]), ["citations[0]"]),
    (answer(citations=[cite("e1")] * 33), ["citations"] + [f"citations[{k}]" for k in range(1, 33)]),
    (answer(claims=[]), ["claims"]),
    (answer(claims=[CLAIM | {"workspace": ""}]), ["claims[0]"]),
    (answer(claims=[CLAIM, CLAIM | {"citations": []}]), ["claims[1]"]),
    (answer(claims=[CLAIM | {"citations": [cite("e7")]}]), ["claims[0].citations[0]"]),
    (answer() | {"more": 1}, ["answer"]),
    ({"judgment": {"disposition": "assessed"}}, ["answer"]),
    ([], ["answer"]),
    ("{", ["answer"]),
    (None, ["answer"]),
]


def test_faults(spark):
    rows = [(str(k), doc if doc is None or doc == "{" else json.dumps(doc)) for k, (doc, _) in enumerate(CASES)]
    packet = spark.createDataFrame([(str(k), e) for k in range(len(CASES)) for e in ("e1", "e2")], "answer_id string, event_id string")
    found = {}
    for r in answers.answer_breaches(spark.createDataFrame(rows, "answer_id string, doc string"), packet).collect():
        found.setdefault(int(r["answer_id"]), []).append(r["place"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(w) for k, (_, w) in enumerate(CASES) if w}
