"""Connected components by alternating large and small stars, all in DataFrame operations.

Every step reads and writes tables in the shared folder. A node's minimum is a partial aggregate, and
it meets the node's edges in a join whose two sides have exchanges of their own, so that adaptive
execution can split a hub's edges over tasks. The number of rounds is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import scratch_scope, written

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, root: every node that has an edge to another one, with its component's least node."""
    spark = edges.sparkSession
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        with scratch_scope(spark):  # a round's own tables go with it
            both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "large")
            least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-least")
            large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
            least = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
            joined = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
            e = written(joined.where("u <> v").distinct(), "small-star", kept=True)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components: not done after {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
