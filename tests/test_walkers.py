import itertools

from pyspark.sql import functions as F

from tracemill.functions import walkers
from tracemill.operators import sampling, sequences, units


def test_walks():
    message = {"content": [{"type": "text", "text": "a"}, {"type": "thinking", "text": "no"}, {"inner": {"type": "text", "text": "b"}}], "signature": "s"}
    assert list(walkers.visible_text(message)) == ["a", "b"] and list(walkers.visible_text("x")) == ["x"]
    assert list(walkers.result_text({"id": "no", "out": ["x", {"y": "z"}]})) == ["x", "z"]
    assert walkers.edit_lines({"old_string": "a\nb", "new_string": "c"}) == (1, 2)
    assert walkers.edit_lines({"patch": "+++ f\n+a\n-b\n c"}) == (1, 1)
    assert list(walkers.folders({"a": [{"cwd": "/w"}, {"x": {"root": "/r"}}]})) == ["/w", "/r"]
    assert walkers.blind({"big-model says": ["big-model-2"]}, {"big-model": "M"}) == {"M says": ["M-2"]}


def test_spread():
    assert sequences.spread(0) == [] and sequences.spread(1) == [0] and sequences.spread(5) == [0, 4, 2, 1, 3]
    assert all(sorted(sequences.spread(n)) == list(range(n)) for n in range(40))


def test_columns(spark):
    f = walkers.udfs(spark)
    row = spark.createDataFrame([('{"type": "text", "text": "hi", "old": "a"}',), (None,), ("no json",)], "j string")
    got = row.select(f["visible_text"]("j").alias("v"), f["edit_lines"]("j").alias("e"), f["folders"]("j").alias("f")).collect()
    assert [r["v"] for r in got] == ["hi", "", "no json"] and got[0]["e"]["added"] == 1 and got[0]["e"]["removed"] == 1 and got[1]["f"] == []
    rows = spark.createDataFrame([("p", k) for k in range(5)] + [("q", 9)], "g string, k int")
    assert [r["k"] for r in sequences.spread_order(rows, ["g"], ["k"]).where("g = 'p'").orderBy("visit").collect()] == [0, 4, 2, 1, 3]


def test_correlation(spark):
    one = spark.createDataFrame([("a", "c1", "r1"), ("b", None, "r2"), ("c", None, None)], "id string, call string, response string")
    two = spark.createDataFrame([("x", "c1", "r1"), ("y", None, "r2"), ("z", "c9", None)], "id string, call string, response string")
    got = {(r["left_id"], r["right_id"]): r["by"] for r in sequences.correlate(one, two, {"call": F.col("call"), "response": F.col("response")}).collect()}
    assert got == {("a", "x"): ["call", "response"], ("b", "y"): ["response"]}


def test_queue(spark):
    cells = spark.createDataFrame(list(itertools.product(["t1", "t2"], ["m1", "m2"], ["h"], [1, 2])), "task_id string, model_id string, harness_id string, trial_id int")
    for strategy in ("declared", "shuffled", "by-task", "by-model"):
        queue = sampling.compile_queue(cells, "e", strategy, "s")
        got = queue.orderBy("position").collect()
        assert [r["position"] for r in got] == list(range(8)) and len({r["run_id"] for r in got}) == 8
        assert sampling.queue_breaches(queue, cells).count() == 0
    assert {r["task_id"] for r in sampling.compile_queue(cells, "e", "by-task", "s").where("position < 2").collect()} == {"t1", "t2"}
    assert {r["problem"] for r in sampling.queue_breaches(cells.limit(7).unionByName(cells.limit(1)), cells).collect()} == {"missing", "repeated"}


def test_spread_order_of_every_size(spark):
    rows = spark.createDataFrame([(n, k) for n in range(1, 41) for k in range(n)], "g long, k long")
    found = {}
    for r in sequences.spread_order(rows, ["g"], ["k"]).collect():
        found.setdefault(r["g"], {})[r["visit"]] = r["k"]
    assert all([found[n][v] for v in range(n)] == sequences.spread(n) for n in found)


def test_tracks_are_the_first_free_ones(spark):
    rnd = __import__("random").Random(2)
    calls = [(g, k, s := rnd.randrange(60), s + rnd.randrange(12)) for g in range(3) for k in range(70)]
    want = {}
    for g in range(3):
        ends = []
        for _, k, s, e in sorted((c for c in calls if c[0] == g), key=lambda c: (c[2], c[3], c[1])):
            track = next((t for t, x in enumerate(ends) if x <= s), len(ends))
            ends[track : track + 1] = [e]
            want[(g, k)] = track
    found = units.pack_tracks(spark.createDataFrame(calls, "g long, k long, start long, end long"), "g", "k").collect()
    assert {(r["g"], r["k"]): r["track"] for r in found} == want


def test_words_outside_of_the_basic_plane_hash_by_their_units(spark):
    from pyspark.sql import functions as F

    from tracemill.operators import vectors

    def fnv(word):
        h = 2166136261
        raw = word.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619 % 2**32
        return h

    words = ["plain", "né", "日本", "a😀b", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", vectors.fnv1a(F.col("w")).alias("h")).collect()
    assert {r["w"]: r["h"] for r in rows} == {w: fnv(w) for w in words}
