"""Queries over telemetry on the wire: requests that executors encode from the tables' rows, decoded again."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.registry import query
from tracemill.sources import metrics
from tracemill.sources.shipping import ship
from tracemill.sources.tables import table


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order: a gauge and a sum with a point a line, and a histogram of the lines' discounts."""
    ship(spark)
    line = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("double").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"), F.col("l_returnflag").alias("mode"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order has few lines

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, a = metrics.field, metrics.attribute
        # a point's first fields have a fixed form: the time (3) and a double (4) or a fixed number (6); the tails are few
        gauge_head, total_head, mask = struct.Struct("<BQBd").pack, struct.Struct("<BQBQ").pack, (1 << 64) - 1
        gauge_tail = lru_cache(4096)(lambda mode, n: f(7, a("mode", mode)) + f(99, n))
        total_tail = lru_cache(4096)(lambda n: f(7, a("line", n)))
        for b in batches:
            bodies, at = [], b["lines"].offsets.to_pylist()
            lines = list(zip(*(c.to_pylist() for c in b["lines"].flatten().flatten()), strict=True))
            for key, lo, hi in zip(b["l_orderkey"].to_pylist(), at, at[1:], strict=False):
                own = lines[lo - at[0] : hi - at[0]]
                gauge = b"".join(f(1, gauge_head(25, t * 1000 & mask, 33, quantity) + gauge_tail(mode, n)) for n, quantity, _, _, t, mode in own)
                total = b"".join(f(1, total_head(25, t * 1000 & mask, 49, -cents & mask) + total_tail(n)) for n, _, cents, _, t, _ in own) + f(2, 2) + f(3, True)
                cells, discounts = [0, 0, 0], [x[3] for x in own]
                for x in discounts:
                    cells[(x >= 3) + (x >= 6)] += 1
                packed = b"".join(n.to_bytes(8, "little") for n in cells)
                bounds = f(7, 0.03) + f(7, 0.06)
                histogram = f(1, f(4, ("fixed", len(own))) + f(5, float(sum(discounts))) + f(6, packed) + bounds) + f(2, 1)
                kinds = f(2, f(1, "quantity") + f(3, "1") + f(5, gauge)) + f(2, f(1, "price") + f(3, "cent") + f(7, total)) + f(2, f(1, "discount") + f(9, histogram))
                bodies.append(f(1, f(1, f(1, a("order", key))) + f(2, f(1, f(1, "lines")) + kinds)))
            yield pa.RecordBatch.from_arrays([b["l_orderkey"], pa.array(bodies, pa.binary())], names=["l_orderkey", "body"])

    return orders.mapInArrow(encode, "l_orderkey long, body binary")


_LINES = "l AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS HUGEINT) * 1000 AS stamp, l_returnflag AS mode FROM lineitem)"


@query(f"""
WITH {_LINES}
SELECT l_orderkey, 'quantity' AS metric, 'gauge' AS kind, '[{{"key":"mode","value":{{"stringValue":"' || mode || '"}}}}]' AS attributes, '{{"99":["' || n || '"]}}' AS unknown, CAST(stamp AS VARCHAR) AS time_nanos, quantity AS as_double, CAST(NULL AS BIGINT) AS as_int,
       CAST(NULL AS INTEGER) AS temporality, CAST(NULL AS VARCHAR) AS buckets, CAST(NULL AS DOUBLE) AS total FROM l
UNION ALL SELECT l_orderkey, 'price', 'sum', '[{{"key":"line","value":{{"intValue":"' || n || '"}}}}]', NULL, CAST(stamp AS VARCHAR), NULL, -cents, 2, NULL, NULL FROM l
UNION ALL SELECT l_orderkey, 'discount', 'histogram', '[]', NULL, NULL, NULL, NULL, 1,
       concat_ws(' ', count(*) FILTER (discount < 3), count(*) FILTER (discount >= 3 AND discount < 6), count(*) FILTER (discount >= 6)), CAST(sum(discount) AS DOUBLE) FROM l GROUP BY l_orderkey
""")
def telemetry_metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.points(_requests(spark, sf_dir), "body", ["l_orderkey"])
    return found.select("l_orderkey", "metric", "kind", "attributes", "unknown", F.col("time_nanos").cast("string").alias("time_nanos"), "as_double", "as_int", "temporality", F.when(F.col("bucket_counts").isNotNull(), F.array_join("bucket_counts", " ")).alias("buckets"), F.col("sum").alias("total"))


@query(f"""
WITH {_LINES}
SELECT 'quantity' AS metric, '1' AS unit, count(*) AS points, sum(quantity) AS total FROM l
UNION ALL SELECT 'price', 'cent', count(*), -CAST(sum(cents) AS DOUBLE) FROM l
UNION ALL SELECT 'discount', NULL, count(DISTINCT l_orderkey), CAST(sum(discount) AS DOUBLE) FROM l
""")
def telemetry_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests through the table function in SQL."""
    metrics.register(spark)
    _requests(spark, sf_dir).createOrReplaceTempView("metric_requests")
    return spark.sql("SELECT p.metric, p.unit, count(*) AS points, sum(coalesce(p.as_double, p.as_int, p.sum)) AS total FROM metric_requests, LATERAL otlp_metric_points(body) p GROUP BY p.metric, p.unit")
