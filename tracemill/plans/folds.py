"""Queries of what adapters carry from record to record, over records made of the tables' own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import folds, normalize
from tracemill.plans.registry import query
from tracemill.sources.tables import table


def _native(rows: DataFrame, harness: str, attempt: Column, line: Column, doc: Column, kind: str = "session") -> DataFrame:
    user = attempt.cast("string")
    return rows.select(user.alias("run_id"), user.alias("attempt_id"), F.lit("stream").alias("artifact_id"), F.concat(F.lit("line:"), line.cast("string")).alias("locator"), F.lit(harness).alias("harness"), F.lit(kind).alias("kind"), F.to_json(doc).alias("doc"))


@query("""
WITH m AS (
  SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS input_tokens, CASE WHEN turn % 4 <> 3 THEN CAST(length(role) * turn AS BIGINT) END AS cache_read_tokens, CASE WHEN length(text) % 2 = 0 THEN CAST(length(text) // 2 AS BIGINT) END AS cache_creation_tokens,
         CASE WHEN length(text) % 5 = 0 THEN 'subagent' ELSE 'assistant' END AS usage_scope
  FROM conversations WHERE role = 'assistant' AND length(text) > 0
)
SELECT CAST(conv_id AS VARCHAR) AS attempt_id, conv_id || '-' || turn AS message_id, 'm' || turn % 3 AS model_id, input_tokens, cache_read_tokens, cache_creation_tokens, usage_scope,
       row_number() OVER w AS requests, CAST(sum(input_tokens) OVER w AS BIGINT) AS total_input_tokens
FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def agent_sdk_request_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each line of an assistant's turn, all with the turn's usage; some counts are no whole numbers."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' AND length(text) > 0")
    rows = turns.select("*", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    size = F.length("text")
    usage = F.struct(size.alias("input_tokens"), F.when(F.col("turn") % 4 == 3, -1).otherwise(F.length("role") * F.col("turn")).alias("cache_read_input_tokens"), (size / 2).alias("cache_creation_input_tokens"))
    inner = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("m"), (F.col("turn") % 3).cast("string")).alias("model"), usage.alias("usage"), F.array(F.struct(F.lit("text").alias("type"), F.col("line").alias("text"))).alias("content"))
    parent = F.when(size % 5 == 0, F.concat(F.lit("call-"), F.col("turn").cast("string")))
    doc = F.struct(F.lit("assistant").alias("nativeType"), F.struct(inner.alias("message"), parent.alias("parent_tool_use_id")).alias("message"))
    native = _native(rows, "agent-sdk", F.col("conv_id"), F.col("turn") * 100_000 + F.col("n"), doc)
    return folds.request_usage(native).drop("run_id", "artifact_id", "locator")


_K = "CAST(substr(props, 7, length(props) - 7) AS BIGINT)"


def _devin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    kind = F.col("event_type")
    end = F.when(kind.isin("click", "error") & (F.col("k") % 3 != 0), F.struct((F.col("k") % 7).alias("exit_code"), F.when(F.col("k") % 5 == 0, "TERM").alias("signal")))
    meta = F.struct(end.alias("terminal_exit"), F.concat(F.lit("tool"), (F.col("k") % 4).cast("string")).alias("cognition.ai/inferenceToolName"), F.when(F.col("k") % 11 == 0, True).alias("cognition.ai/canceled"))
    update = F.struct(
        F.when(kind == "view", "tool_call").when(kind == "signup", "usage_update").otherwise("tool_call_update").alias("sessionUpdate"),
        F.when(kind == "click", "in_progress").when(kind == "purchase", "completed").when(kind == "error", "failed").alias("status"),
        F.when(F.col("k") % 13 != 0, F.concat(F.lit("c"), (F.col("k") % 6).cast("string"))).alias("toolCallId"),
        F.when(kind == "view", F.struct(F.col("value"))).alias("rawInput"),
        meta.alias("_meta"),
    )
    doc = F.struct(F.col("event_id").alias("sequence"), F.lit("notification").alias("kind"), F.lit("session/update").alias("method"), F.struct(F.col("user_id").cast("string").alias("sessionId"), update.alias("update")).alias("payload"))
    return _native(e, "devin", F.col("user_id"), F.col("event_id"), doc)


@query(f"""
WITH e AS (
  SELECT user_id, event_id, event_type, {_K} AS k, CASE WHEN {_K} % 13 <> 0 THEN 'c' || {_K} % 6 END AS call_id,
         CASE WHEN event_type IN ('click', 'error') AND {_K} % 3 <> 0 THEN {{'x': {_K} % 7, 's': CASE WHEN {_K} % 5 = 0 THEN 'TERM' END}} END AS done FROM events WHERE event_type <> 'signup'
), w AS (
  SELECT *, last_value(done IGNORE NULLS) OVER p AS found, first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER p AS began
  FROM e WINDOW p AS (PARTITION BY user_id, call_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
)
SELECT CAST(user_id AS VARCHAR) AS attempt_id, event_id AS order_value, call_id, CASE event_type WHEN 'view' THEN 'before' ELSE 'after' END AS phase, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
       'tool' || k % 4 AS tool_name, event_type <> 'view' AND k % 11 = 0 AS canceled,
       CASE WHEN event_type = 'view' THEN NULL WHEN call_id IS NULL THEN done.x ELSE found.x END AS exit_code, CASE WHEN event_type = 'view' THEN NULL WHEN call_id IS NULL THEN done.s ELSE found.s END AS signal,
       CASE WHEN event_type <> 'view' AND call_id IS NOT NULL THEN 'devin:' || began || ':tool_call' END AS parent_id
FROM w WHERE event_type <> 'click'
""")
def devin_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.devin_calls(_devin(spark, sf_dir)).drop("run_id", "artifact_id", "locator", "id", "input_digest")


@query("""
WITH t AS (SELECT conv_id, turn, text, role = 'assistant' AS agent FROM conversations WHERE length(text) > 0),
l AS (SELECT *, CASE WHEN lag(agent) OVER w = agent AND lag(turn) OVER w % 5 <> 4 THEN 0 ELSE 1 END AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM l)
SELECT CAST(conv_id AS VARCHAR) AS attempt_id, min(turn) * 100000 AS order_value, CASE WHEN any_value(agent) THEN 'agent' ELSE 'user' END AS speaker, CAST(sum((length(text) + 39) // 40) AS BIGINT) AS chunks, string_agg(text, '' ORDER BY turn) AS text
FROM g GROUP BY conv_id, n
""")
def devin_message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in chunks of 40 characters; after every fifth turn a plan comes between."""
    turns = table(spark, sf_dir, "conversations").where("length(text) > 0")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40)), lambda k: F.substring(F.col("text"), (k * 40 + 1).cast("int"), F.lit(40)))
    parts = F.when(F.col("turn") % 5 == 4, F.concat(parts, F.array(F.lit(None).cast("string")))).otherwise(parts)
    rows = turns.select("*", F.posexplode(parts).alias("n", "chunk"))
    speaker = F.when(F.col("chunk").isNull(), "plan").when(F.col("role") == "assistant", "agent_message_chunk").otherwise("user_message_chunk")
    update = F.struct(speaker.alias("sessionUpdate"), F.struct(F.lit("text").alias("type"), F.col("chunk").alias("text")).alias("content"))
    order = F.col("turn") * 100_000 + F.col("n")
    doc = F.struct(order.alias("sequence"), F.lit("notification").alias("kind"), F.lit("session/update").alias("method"), F.struct(update.alias("update")).alias("payload"))
    return folds.devin_messages(_native(rows, "devin", F.col("conv_id"), order, doc)).drop("run_id")


@query(f"""
WITH e AS (SELECT user_id, event_id, {_K} AS k FROM events),
r AS (
  SELECT user_id, event_id, k, c.channel, c.n FROM e JOIN (VALUES ('websocket-event', 0), ('websocket-event', 1), ('rest-event', 2), ('rest-event', 3)) c(channel, n)
  ON n = 0 OR (n = 1 AND k % 3 = 0) OR (n = 2 AND k % 4 <> 0) OR (n = 3 AND k % 10 = 1)
), b AS (
  SELECT *, k % 17 = 0 AS nameless, max(CASE WHEN n > 1 THEN n END) OVER (PARTITION BY event_id) AS rest FROM r
), c AS (
  SELECT *, NOT nameless AND n = coalesce(rest, 0) AS canonical FROM b
)
SELECT CAST(user_id AS VARCHAR) AS attempt_id, channel, CASE WHEN canonical THEN NULL WHEN NOT nameless AND n < 2 THEN '{folds.DUPLICATE}' ELSE '{folds.NO_MAPPING}' END AS reason, canonical,
       count(*) AS records, CAST(sum(n) AS BIGINT) AS copies FROM c GROUP BY ALL
""")
def openhands_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a socket and a REST channel give up to twice each; some records have no id of their own."""
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    copies = F.array(F.lit(0), F.when(F.col("k") % 3 == 0, 1), F.when(F.col("k") % 4 != 0, 2), F.when(F.col("k") % 10 == 1, 3))
    rows = e.select("*", F.explode(F.array_compact(copies)).alias("n"))
    payload = F.struct(F.when(F.col("k") % 17 != 0, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("id"), F.lit("MessageEvent").alias("kind"), F.col("value"))
    line = F.col("event_id") * 4 + F.col("n")
    doc = F.struct(line.alias("sequence"), F.when(F.col("n") < 2, "websocket-event").otherwise("rest-event").alias("channel"), F.col("user_id").cast("string").alias("session_id"), payload.alias("payload"))
    found = folds.openhands_canonical(_native(rows, "openhands", F.col("user_id"), line, doc))
    copy = F.regexp_extract("locator", "line:(\\d+)", 1).cast("bigint") % 4
    return found.groupBy("attempt_id", "channel", "canonical", "reason").agg(F.count("*").alias("records"), F.sum(copy).alias("copies"))


@query(f"""
WITH e AS (SELECT user_id, event_id, {_K} % 20 AS c, event_type IN ('view', 'click') AS b FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')),
g AS (SELECT user_id, c, min(event_id) FILTER (b) AS began, min(event_id) FILTER (NOT b) AS ended, count(*) FILTER (NOT b) AS ends FROM e GROUP BY user_id, c)
SELECT CAST(user_id AS VARCHAR) AS attempt_id, 'c' || c AS call_id, began, ended, ends,
       CASE WHEN began IS NULL THEN 'end-without-beginning' WHEN ended IS NULL THEN 'open' WHEN ended < began THEN 'ended-before' ELSE 'ended' END AS state,
       CASE WHEN began IS NOT NULL THEN (SELECT CAST(count(*) FILTER (o.began < g.began) - count(*) FILTER (o.ended < g.began) AS BIGINT) FROM g o WHERE o.user_id = g.user_id AND o.began IS NOT NULL) END AS beside
FROM g
""")
def pi_open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool executions of a session that start and end, normalized, then folded by call."""
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")).where("event_type IN ('view', 'click', 'purchase', 'error')")
    begins = F.col("event_type").isin("view", "click")
    payload = F.struct(F.when(begins, "tool_execution_start").otherwise("tool_execution_end").alias("type"), F.concat(F.lit("c"), (F.col("k") % 20).cast("string")).alias("toolCallId"), F.lit("bash").alias("toolName"))
    doc = F.struct(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("sessionId"), payload.alias("payload"))
    return folds.open_items(normalize.normalize(_native(e, "pi", F.col("user_id"), F.col("event_id"), doc)))
