"""The driver's tables, and the views of them that stand for an agent corpus.

run = customer, attempt = order, task = nation, model = market segment, harness = region; one event per
row of ``events``, whose session and order domain are the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
    )
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("interrupted")
    capture = F.create_map(*(F.lit(x) for pair in {"1-URGENT": "qualified", "2-HIGH": "qualified-with-gaps", "3-MEDIUM": "incomplete", "4-NOT SPECIFIED": "unqualified"}.items() for x in pair))
    return joined.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("attempt_id"),
        F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("attempt_number"),
        F.col("n_name").alias("task_id"),
        F.col("c_mktsegment").alias("model_id"),
        F.col("r_name").alias("harness_id"),
        (F.col("o_orderkey") % 3 + 1).alias("trial_id"),
        state.alias("terminal_state"),
        F.try_element_at(capture, F.col("o_orderpriority")).alias("capture_qualification"),
        F.col("o_totalprice").alias("cost"),
        F.col("o_orderdate").alias("started_at"),
    )


ATTEMPTS_SQL = """
attempts AS (
  SELECT o.o_custkey AS run_id, o.o_orderkey AS attempt_id,
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS attempt_number,
         n.n_name AS task_id, c.c_mktsegment AS model_id, r.r_name AS harness_id, 1 + o.o_orderkey % 3 AS trial_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'interrupted' END AS terminal_state,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'qualified' WHEN '2-HIGH' THEN 'qualified-with-gaps'
              WHEN '3-MEDIUM' THEN 'incomplete' WHEN '4-NOT SPECIFIED' THEN 'unqualified' END AS capture_qualification,
         o.o_totalprice AS cost, o.o_orderdate AS started_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("CAST(substr(props, 7, length(props) - 7) AS BIGINT)")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        "ts",
        F.col("event_id").alias("native_order"),
        F.concat(F.lit("tool"), (k % 4).cast("string")).alias("tool_name"),
        k.alias("input_digest"),
        (F.col("event_type") == "error").alias("failed"),
        "event_type",
        "value",
    )


OPERATIONS_SQL = """
operations AS (
  SELECT event_id, user_id AS session_id, ts, event_id AS native_order,
         concat('tool', CAST(CAST(substr(props, 7, length(props) - 7) AS BIGINT) % 4 AS VARCHAR)) AS tool_name,
         CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS input_digest, event_type = 'error' AS failed, event_type, value
  FROM events
)"""
