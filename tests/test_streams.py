"""Folds over streams: how records fall into batches doesn't matter, late ones wait, idle scopes are closed."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracemill.sources import bundles, tail
from tracemill.streaming import chains, evidence, monitor

OPS = "id long, ts string, scope string, tool string, failed boolean"
LAST = [(None, "2050-01-01 00:00:00", None, None, None)]


def replayed(spark, batches, fold, schema):
    d = tempfile.mkdtemp(prefix="spark-")
    with chains.state_store(spark) as own:
        for rows in batches:
            spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{d}/in")
            stream = own.readStream.schema(own.read.parquet(f"{d}/in").schema).parquet(f"{d}/in")
            monitor.replay(fold(chains.timed(stream, "ts", "1 minute")), f"{d}/out", f"{d}/state", "append")
    return sorted((tuple(r) for r in spark.read.parquet(f"{d}/out").drop("batch").collect()), key=str)


def test_late_records_are_folded_in_their_order(spark):
    rows = [(1, "2024-01-01 00:00:01", "s", "a", True), (2, "2024-01-01 00:00:02", "s", "a", True), (3, "2024-01-01 00:00:03", "s", None, True), (4, "2024-01-01 00:00:03", "s", "a", False), (5, "2024-01-01 00:00:09", "s", None, True), (6, None, "s", "a", True)]
    found = replayed(spark, [rows[1:3], rows[:1] + rows[4:], rows[3:4], LAST], lambda r: chains.failure_chains(r, "scope", 10**10), OPS)
    assert found == [("s", "a", 2, 1, 2, 4, "passed"), ("s", None, 1, 3, 3, 5, "failed"), ("s", None, 1, 5, 5, None, "none")]


def test_idle_scopes_end_and_start_anew(spark):
    rows = [(1, "2024-01-01 00:00:01", "s", "a", True), (2, "2024-01-03 00:00:01", "s", "a", True), (3, "2024-01-03 00:00:02", "t", "a", False)]
    found = replayed(spark, [rows, LAST], lambda r: chains.failure_chains(r, "scope", 86_400_000), OPS)
    assert found == [("s", "a", 1, 1, 1, None, "none"), ("s", "a", 1, 2, 2, None, "none")]


def test_boundaries_end_at_breaks_and_repeats(spark):
    rows = [(k, f"2024-01-01 00:00:{k:02d}", "s", kind, breaks) for k, (kind, breaks) in enumerate([("x", False), ("y", False), (None, False), ("x", False), (None, True), ("y", False)])]
    found = replayed(spark, [rows[::2], rows[1::2], LAST], lambda r: chains.compaction_boundaries(r, "scope", 10**10), "id long, ts string, scope string, kind string, breaks boolean")
    assert found == [("s", 0, 2, 0, 1, ["x", "y"]), ("s", 1, 1, 3, 3, ["x"]), ("s", 2, 1, 5, 5, ["y"])]


class Asked:
    """States of one scope; counts how often they are asked."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def state(self, name, *shape):
        asked = self

        class State:
            def __getattr__(self, what):
                def call(*args):
                    asked.calls += 1
                    held = asked.held
                    if what in ("update", "put"):
                        held[name] = args[0]
                    elif what == "appendList":
                        held[name] = [*held.get(name, []), *args[0]]
                    elif what == "clear":
                        held.pop(name, None)
                    elif what == "updateValue":
                        held.setdefault(name, {})[args[0]] = args[1]
                    elif what == "removeKey":
                        held[name].pop(args[0])
                    elif what == "exists":
                        return name in held
                    elif what == "containsKey":
                        return args[0] in held.get(name, {})
                    elif what == "getValue":
                        return held[name][args[0]]
                    elif what == "iterator":
                        return iter(held.get(name, {}).items())
                    elif what == "get":
                        return held.get(name, [] if name == "waiting" else None)

                return call

        return State()

    def __getattr__(self, what):
        return self.state if what.startswith("get") else self.state(what).update


@pytest.mark.parametrize("fold, columns, row", [(chains.FailureChains, "tool failed", lambda k: ("ab"[k % 2], k % 3 > 0)), (chains.Boundaries, "kind breaks", lambda k: ("ab"[k % 2], k % 5 == 0))])
def test_state_is_asked_for_once_a_call(fold, columns, row):
    import pandas as pd

    class Time:
        def getCurrentWatermarkInMs(self):
            return self.at

    def run(n):
        asked, f, now, out = Asked(), fold(10**10), Time(), []
        f.init(asked)
        for part, now.at in ((range(0, n, 2), -1), (range(1, n, 2), n // 2), ([], n), ([], 10**11)):
            frame = pd.DataFrame([(k * 1000, k, *row(k)) for k in part], columns=["at", "id", *columns.split()])
            found = f.handleInputRows(("s",), iter([frame]), now) if len(frame) else f.handleExpiredTimer(("s",), now, None)
            out += [r for x in found for r in x.itertuples(index=False)]
        assert len(out) > n // 3 and not any(asked.held.get(k) for k in ("waiting", "clock", "run", "unanswered", "current", "count"))
        return asked.calls

    assert run(400) <= run(40) + 4


def tailed(spark, d):
    monitor.replay(tail.tail(spark, f"{d}/in"), f"{d}/out", f"{d}/state", "append")
    rows = spark.read.parquet(f"{d}/out")
    last = rows.agg(F.max("batch")).first()[0]
    return sorted((os.path.basename(r["path"]), r["at"], r["text"]) for r in rows.where(F.col("batch") == last).collect())


def test_tail_gives_complete_new_lines_and_resets(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{d}/in")

    def put(name, text, mode="a"):
        with open(f"{d}/in/{name}", mode, newline="") as f:
            f.write(text)

    put("a.jsonl", '{"a":1}\n\n{"a":2}\r\nopen é')
    put("b.jsonl", "x\ny\nz\n")
    put("c.txt", "not one of them\n")
    assert tailed(spark, d) == [("a.jsonl", 0, '{"a":1}'), ("a.jsonl", 9, '{"a":2}'), ("b.jsonl", 0, "x"), ("b.jsonl", 2, "y"), ("b.jsonl", 4, "z")]
    put("a.jsonl", " end\nnext\nopen")
    put("b.jsonl", "v\nw\n", "w")  # truncated and shorter
    assert tailed(spark, d) == [("a.jsonl", 18, "open é end"), ("a.jsonl", 30, "next"), ("b.jsonl", 0, "v"), ("b.jsonl", 2, "w")]
    put("b.jsonl", "written anew in place\n", "w")
    put("new", "".join(f"{k}\n" for k in range(30)), "w")
    os.replace(f"{d}/in/new", f"{d}/in/a.jsonl")  # another file of that name
    assert tailed(spark, d) == sorted([("b.jsonl", 0, "written anew in place"), *(("a.jsonl", 2 * k - min(0, 10 - k) * (k > 10), str(k)) for k in range(30))])
    put("b.jsonl", "more\n")
    os.remove(f"{d}/in/a.jsonl")
    assert tailed(spark, d) == [("b.jsonl", 22, "more")]


def test_ranges_share_a_files_lines(tmp_path):
    lines = ["x" * (k % 7) + str(k) for k in range(200)]
    path = tmp_path / "f"
    path.write_text("\n".join(lines) + "\n")
    size = path.stat().st_size
    import pyarrow.fs as fs

    for step in (1, 5, 64, size):
        got = []
        for at in range(0, size, step):
            with fs.LocalFileSystem().open_input_file(str(path)) as f:
                got += [t for rows in tail._lines(f, tail.Range(str(path), at, min(at + step, size), at == 0), block=16) for _, t in rows]
        assert got == lines


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3)):
        with open(tmp_path / f"{name}.jsonl", "w", newline="") as f:
            f.writelines(f"{json.dumps({'n': k})}\r\n" if k % 5 else "\n" for k in range(1, n + 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = bundles.jsonl(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted((os.path.basename(r["path"]), int(r["locator"].removeprefix("line:")), r["text"]) for r in rows)
    assert got == sorted((f"{name}.jsonl", k, json.dumps({"n": k})) for name, n in (("a", 400), ("b", 3)) for k in range(1, n + 1) if k % 5)


@pytest.mark.parametrize("stage", ["records", "heads"])
def test_evidence_has_no_gap_and_no_repeat_after_a_failure(spark, tmp_path, stage):
    log = evidence.EvidenceLog(spark, str(tmp_path), "log", ["n"])
    batch = lambda *rows: spark.createDataFrame(rows, "log string, n long")

    def stop(at):
        if at == stage:
            raise RuntimeError(at)

    assert log.read() is None and log.committed() == []
    log.append(batch(("a", 2), ("a", 1), (None, 5)), 0)
    with pytest.raises(RuntimeError):
        log.append(batch(("a", 3), ("b", 1)), 1, stop)
    assert log.committed() == [0] and log.read().count() == 3  # what isn't committed isn't seen
    again = evidence.EvidenceLog(spark, str(tmp_path), "log", ["n"])
    again.append(batch(("a", 3), ("b", 1)), 1)
    again.append(batch(("a", 9)), 1)  # committed already
    again.append(batch(("a", 4), ("a", 4), (None, 6)), 4)
    got = sorted(((r["log"] or "", r["n"], r["sequence"]) for r in again.read().collect()))
    assert got == [("", 5, 0), ("", 6, 1), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 4, 4), ("b", 1, 0)]
    assert again.breaches().count() == 0
