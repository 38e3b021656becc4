"""Counts below two bounds, and changes between events of two domains, against brute force."""

import random

from tracemill.operators import intervals

KINDS = "by long, id long, domain string, value long, time long, change boolean"


def test_below_both(spark):
    rnd = random.Random(4)
    points = [(g, r, rnd.randrange(20)) for g, n in ((1, 37), (2, 1), (3, 64)) for r in range(n)]
    probes = [(g, rnd.randrange(70), rnd.choice([None, *range(22)]), k) for k, g in enumerate([1, 2, 3, 4] * 30)]
    probes = [(g, min(r, sum(p[0] == g for p in points)), t, k) for g, r, t, k in probes]
    found = intervals.below_both(spark.createDataFrame(points, "g long, rank int, t long"), spark.createDataFrame(probes, "g long, rank int, t long, k long"), ["g"], "rank", "t")
    want = {k: sum(p[0] == g and p[1] < r and p[2] < t for p in points) for g, r, t, k in probes if t is not None}
    assert {r["k"]: r["below"] for r in found.collect()} == want


def order(a, b):
    if a["id"] == b["id"]:
        return 0
    x, y = (a["value"], b["value"]) if a["domain"] == b["domain"] else (a["time"], b["time"])
    return None if x is None or y is None or x == y else (x > y) - (x < y)


def between(events, a, b):
    n = 0
    for c in events:
        if c["change"]:
            after, before = order(a, c), order(c, b)
            if after is None or before is None:
                return None
            n += after < 0 and before < 0
    return n


def test_changes_between_against_brute_force(spark):
    rnd = random.Random(6)
    events = []
    for by in range(12):
        gap = by % 3 == 0
        for k in range(rnd.choice([3, 9, 25])):
            events.append({"by": by, "id": 100 * by + k, "domain": rnd.choice("abc"[: 1 + by % 3]), "value": rnd.randrange(9) if by % 4 == 1 else 1000 - 7 * k if by % 4 == 2 else k, "time": None if gap and rnd.random() < 0.05 else rnd.randrange(12) if by % 5 == 1 else rnd.randrange(10**6), "change": rnd.random() < 0.4})
    pairs = {(e["by"], e["id"], f["id"]) for e in events for f in events if e["by"] == f["by"] and rnd.random() < 0.25}
    names = [c.split()[0] for c in KINDS.split(", ")]
    found = intervals.changes_between(spark.createDataFrame([tuple(e[n] for n in names) for e in events], KINDS), "by", spark.createDataFrame(sorted(pairs), "by long, from_id long, to_id long"))
    known = {e["id"]: e for e in events}
    want = {(by, a, b): between([e for e in events if e["by"] == by], known[a], known[b]) for by, a, b in pairs}
    got = {(r["by"], r["from_id"], r["to_id"]): r["changes"] for r in found.collect()}
    assert {k for k in want if got.get(k, -1) != want[k]} == set() and len(got) == len(want)
    assert sum(v is None for v in want.values()) > 20 and sum(v is not None and v > 0 for v in want.values()) > 20
