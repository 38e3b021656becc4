"""Queries of all kinds of occurrences and observations, over events that carry commands, tasks, compactions and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import occurrences
from tracemill.plans.registry import query
from tracemill.sources.tables import table

_COMMANDS = ("pnpm run test", "sed -i s/a/b/ src/m.ts", "git status", "npx eslint .")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and errors are tool calls with a command (every fifth an edit, some without a call id), clicks are messages,
    purchases delegated tasks, signups compaction records of two kinds with usage."""
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    kind, k = F.col("event_type"), F.col("k")
    is_tool, is_compaction = kind.isin("view", "error"), kind == "signup"
    tool = F.when(k % 5 == 0, "Edit").otherwise("Bash")
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (k % 4 + 1).cast("int"))
    named = {
        "callId": F.when(is_tool & (k % 19 != 0), F.concat(F.lit("c"), F.col("event_id").cast("string"))),
        "toolName": F.when(is_tool, tool),
        "command": F.when(is_tool & (tool == "Bash"), command),
        "inputDigest": F.when(is_tool, F.concat(F.lit("d"), (k % 7).cast("string"))),
        "exitCode": F.when(is_tool, F.when(kind == "error", "1").otherwise("0")),
        "taskId": F.when((kind == "purchase") & (k % 4 != 0), F.concat(F.lit("t"), (k % 3).cast("string"))),
        "subtype": F.when(is_compaction, F.concat(F.lit("compact_"), (k % 2).cast("string"))),
        "resourceSemantics": F.when(is_compaction, "increment"),
        "inputTokens": F.when(is_compaction & (k % 3 == 0), k.cast("string")),
        "thinkingTokens": F.when(is_compaction & (k % 3 == 1), k.cast("string")),
        "totalCostUsd": F.when(is_compaction, F.col("value").cast("string")),
    }
    attributes = F.map_filter(F.create_map(*(x for n, c in named.items() for x in (F.lit(n), c))), lambda _, v: v.isNotNull())
    user = F.col("user_id").cast("string")
    return e.select(
        user.alias("attempt_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.lit("x").alias("harness"),
        F.lit("native").alias("native_type"),
        named["subtype"].alias("subtype"),
        F.col("event_id").alias("order_value"),
        F.concat(F.lit("d"), user).alias("order_domain"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"),
        F.when(is_tool, "tool").when(kind == "click", "message").when(kind == "purchase", "delegation").otherwise("context").alias("family"),
        F.lit("after").alias("phase"),
        F.when(is_tool, "tool").when((kind == "click") & (k % 2 == 0), "harness").when(kind == "click", "user").otherwise("agent").alias("actor_kind"),
        F.lit("session").alias("scope_kind"),
        user.alias("scope_id"),
        attributes.alias("attributes"),
    )


_EVENTS = """
e AS (
  SELECT CAST(user_id AS VARCHAR) AS a, event_id AS n, epoch_us(ts) // 1000 AS t, event_type AS kind, value, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS k,
         event_type IN ('view', 'error') AS is_tool, event_type = 'error' AS failed FROM events
), o AS (
  SELECT a, n, t, k, failed, CASE WHEN k % 5 = 0 THEN 'Edit' ELSE 'Bash' END AS tool, CASE WHEN k % 5 > 0 THEN ['pnpm run test', 'sed -i s/a/b/ src/m.ts', 'git status', 'npx eslint .'][k % 4 + 1] END AS cmd, k % 7 AS dg
  FROM e WHERE is_tool AND k % 19 <> 0
), f AS (
  SELECT *, CASE WHEN failed AND lag(failed) OVER w AND lag(tool) OVER w = tool THEN 0 ELSE 1 END AS b, lead(n) OVER s AS nid, lead(failed) OVER s AS nf, lead(tool) OVER w AS ntool, row_number() OVER d AS again, first_value(n) OVER d AS first_n
  FROM o WINDOW w AS (PARTITION BY a ORDER BY t, n), s AS (PARTITION BY a, tool ORDER BY t, n), d AS (PARTITION BY a, tool, dg ORDER BY t, n)
), g AS (SELECT *, sum(b) OVER (PARTITION BY a ORDER BY t, n ROWS UNBOUNDED PRECEDING) AS island FROM f),
c AS (
  SELECT a, tool, count(*) AS failures, min_by(n, (t, n)) AS first_n, max_by(n, (t, n)) AS last_n, arg_max_null(nid, (t, n)) AS nid, arg_max_null(nf, (t, n)) AS nf FROM g WHERE failed GROUP BY a, tool, island
), p AS (
  SELECT a, n, t, CASE WHEN kind = 'signup' THEN k % 2 END AS mark, is_tool OR (kind = 'click' AND k % 2 = 1) AS breaks, row_number() OVER (PARTITION BY a ORDER BY t, n) AS i FROM e
), r AS (
  SELECT a, n, mark, i, CASE WHEN mark IS NULL THEN -1 ELSE 0 END AS number, CASE WHEN mark IS NOT NULL THEN [mark] END AS seen FROM p WHERE i = 1
  UNION ALL
  SELECT p.a, p.n, p.mark, p.i, CASE WHEN p.mark IS NOT NULL AND (r.seen IS NULL OR list_contains(r.seen, p.mark)) THEN r.number + 1 ELSE r.number END,
         CASE WHEN p.mark IS NULL THEN CASE WHEN p.breaks THEN NULL ELSE r.seen END WHEN r.seen IS NULL OR list_contains(r.seen, p.mark) THEN [p.mark] ELSE list_append(r.seen, p.mark) END
  FROM p JOIN r ON p.a = r.a AND p.i = r.i + 1
)"""


@query(f"""
WITH RECURSIVE {_EVENTS}
SELECT a AS attempt_id, 'failure-response' AS type, 'e' || first_n AS first_event, false AS heuristic,
       'failures=' || failures || ';lastFailure=e' || last_n || ';nextOutcome=' || CASE WHEN nid IS NULL THEN 'none' WHEN nf THEN 'failed' ELSE 'passed' END || CASE WHEN nid IS NULL THEN '' ELSE ';response=e' || nid END || ';toolName=' || tool AS detail FROM c
UNION ALL SELECT a, 'validation-run', 'e' || n, true, 'checkKinds=' || CASE WHEN cmd LIKE 'pnpm%' THEN 'test' ELSE 'lint' END || ';result=' || CASE WHEN failed THEN 'failed' ELSE 'passed' END || ';toolName=Bash' FROM o WHERE cmd LIKE 'pnpm%' OR cmd LIKE 'npx%'
UNION ALL SELECT a, 'source-change', 'e' || n, true, CASE WHEN tool = 'Edit' THEN 'detectedBy=edit-tool' ELSE 'detectedBy=shell-write;paths=src/m.ts' END || ';toolName=' || tool FROM o WHERE NOT failed AND (tool = 'Edit' OR cmd LIKE 'sed%')
UNION ALL SELECT a, 'repeated-operation', 'e' || n, false, 'firstEvent=e' || first_n || ';toolName=' || tool FROM f WHERE again > 1
UNION ALL SELECT a, 'compaction', 'e' || min(n), true, 'records=' || count(*) FROM r WHERE mark IS NOT NULL GROUP BY a, number
UNION ALL SELECT a, 'delegation', 'e' || min_by(n, (t, n)), false, 'records=' || count(*) || CASE WHEN any_value(k) % 4 <> 0 THEN ';taskId=t' || any_value(k) % 3 ELSE '' END FROM e WHERE kind = 'purchase' GROUP BY a, CASE WHEN k % 4 <> 0 THEN 't' || k % 3 ELSE 'e' || n END
""")
def occurrences_of_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    found = occurrences.occurrences(events, occurrences.operations(events))
    detail = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return found.select("attempt_id", "type", "first_event", "heuristic", detail.alias("detail"))


@query(f"""
WITH RECURSIVE {_EVENTS}, x AS (SELECT a, count(*) FILTER (is_tool) AS native, count(*) FILTER (is_tool AND k % 19 = 0) AS unidentified, count(*) FILTER (kind = 'signup') AS compactions, max(t) - min(t) AS latency FROM e GROUP BY a),
y AS (SELECT a, count(*) AS ops, count(*) FILTER (failed) AS errors, count(*) FILTER (again > 1) AS repeated, count(*) FILTER (failed AND ntool = tool) AS same, count(*) FILTER (failed AND ntool <> tool) AS other FROM f GROUP BY a),
z AS (SELECT x.*, coalesce(ops, 0) AS ops, coalesce(errors, 0) AS errors, coalesce(repeated, 0) AS repeated, coalesce(same, 0) AS same, coalesce(other, 0) AS other FROM x LEFT JOIN y USING (a)),
l AS (
  SELECT a, unnest(['tool-native-record-count', 'tool-unidentified-count', 'tool-operation-count', 'tool-error-count', 'tool-repeated-count', 'failure-to-same-tool', 'failure-to-alternate-tool', 'compaction-count', 'latency-ms']) AS extractor_id,
         unnest([native, unidentified, ops, errors, repeated, same, other, compactions, latency]) AS num FROM z
), u AS (
  SELECT a, 'cost-usd' AS extractor_id, value AS amount FROM e WHERE kind = 'signup' UNION ALL SELECT a, 'input-tokens', k FROM e WHERE kind = 'signup' AND k % 3 = 0 UNION ALL SELECT a, 'thinking-tokens', k FROM e WHERE kind = 'signup' AND k % 3 = 1
)
SELECT a AS attempt_id, extractor_id, 'known' AS status, CASE extractor_id WHEN 'latency-ms' THEN 'millisecond' ELSE 'count' END AS unit, CAST(num AS DOUBLE) AS num FROM l
UNION ALL SELECT a, extractor_id, 'known', CASE extractor_id WHEN 'cost-usd' THEN 'usd' ELSE 'token' END, round(CAST(sum(amount) AS DOUBLE), 4) FROM u GROUP BY a, extractor_id
""")
def observations_of_all_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    found = occurrences.observations(events, occurrences.operations(events), F.lit("available"))
    return found.select("attempt_id", "extractor_id", "status", "unit", F.round("num", 4).alias("num"))
