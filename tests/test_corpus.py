"""Strict JSON, stored indexes, receipts and context packing on odd cases."""

import random

import pytest

from pyspark.sql import functions as F

from tracemill.functions import walkers
from tracemill.functions.text import canonical_json, structural_label
from tracemill.operators import sampling
from tracemill.sources import bundles


@pytest.mark.parametrize(
    "text, canonical",
    [
        ('{"b":1,"a":[2]}', '{"a":[2],"b":1}'), (" [1] ", "[1]"), ("null", "null"), ('"x"', '"x"'), ('{"a":1}}', None), ("{} {}", None), ("{},{}", None),
        ("{}],[{}", None), ('{}},{"v":{}', None), ('1,"w":2', None), ("1 2", None), ('{"a":1,"a":2}', None), ("", None), (" ", None), (None, None),
    ],
)
def test_json_is_one_value_and_nothing_else(spark, text, canonical):
    assert spark.createDataFrame([(text,)], "t string").select(canonical_json(F.col("t"))).first()[0] == canonical


def test_index_keeps_broken_lines_and_is_not_overwritten(spark, tmp_path):
    index = spark.createDataFrame([("b", 2, ["x"]), ("a", None, [])], "manifest_path string, n long, ids array<string>")
    path = str(tmp_path / "index")
    bundles.write_index(index, path)
    with pytest.raises(Exception, match="exist"):
        bundles.write_index(index, path)
    (tmp_path / "index" / "more.txt").write_text('{"n":1}}\n')
    found = {(r.manifest_path, r.n, tuple(r.ids or ()), r.broken) for r in bundles.read_index(spark, path, index.schema).collect()}
    assert found == {("b", 2, ("x",), None), ("a", None, (), None), (None, None, (), '{"n":1}}')}


def test_empty_index(spark, tmp_path):
    index = spark.createDataFrame([], "manifest_path string, n long")
    bundles.write_index(index, str(tmp_path / "none"))
    assert bundles.read_index(spark, str(tmp_path / "none"), index.schema).count() == 0


def test_receipts_of_nulls(spark):
    rows = spark.createDataFrame([(None,), ('{"telemetry":{"receipt":null}}',), ('{"telemetry":{"receipt":{}}}',)], "d string")
    assert [(r.receipt_status, r.receipt) for r in bundles.telemetry_receipts(rows, "d").collect()] == [("absent", None), ("absent", None), (None, "{}")]


def _packed(items, budget):
    """What stays, by trying: the whole cost is counted anew after each step."""
    inside, outside = [], []
    cost = lambda: sum(s for _, s, _ in inside) + sum(n for *_, n in outside)
    for item in items:
        inside.append(item)
        if cost() <= budget:
            continue
        outside.append(inside.pop())
        while cost() > budget and inside:
            outside.append(inside.pop())
    return {k for k, *_ in inside}


def test_packing_gives_way_for_notes(spark):
    rng = random.Random(7)
    rows = [(g, k, rng.randint(0, 40), rng.randint(0, 25)) for g in range(30) for k in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "g int, k int, size long, note long")
    found = sampling.pack_context(df, "g", ["k"], "size", "note", 100).collect()
    assert len(found) == len(rows)
    for g in range(30):
        want = _packed([r[1:] for r in rows if r[0] == g], 100)
        assert {r.k for r in found if r.g == g and r.included} == want
    assert sampling.pack_context(df.where("false"), "g", ["k"], "size", "note", 100).count() == 0


def test_labels_and_blinding_of_nulls(spark):
    row = spark.createDataFrame([(None, "", "other", "shell")], "a string, b string, c string, d string").select(structural_label(*map(F.col, "abcd"))).first()
    assert row[0] == "shell"
    blind = walkers.blinded(spark, {"m": "x"})
    assert [r[0] for r in spark.createDataFrame([(None,), ("m",), ('"m"',), ('["m"]',)], "t string").select(blind("t")).collect()] == [None, "x", '"x"', '["x"]']
