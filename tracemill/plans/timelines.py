"""Queries over ordered events: as-of and nearest joins, chains, islands, carried values, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import sequences as seq
from tracemill.operators import units
from tracemill.plans.registry import query
from tracemill.sources.tables import OPERATIONS_SQL, operations, table


def _seconds(c):
    return F.unix_micros(c.cast("timestamp")) / 1e6


@query(f"""
WITH {OPERATIONS_SQL}, n AS (
  SELECT *, lead(tool_name) OVER w AS nt FROM operations WINDOW w AS (PARTITION BY session_id ORDER BY native_order)
)
SELECT event_id, session_id, tool_name, CASE WHEN nt IS NULL THEN 'none' WHEN nt = tool_name THEN 'same' ELSE 'alternate' END AS response FROM n WHERE failed
""")
def failure_next_same_or_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.failure_responses(operations(spark, sf_dir), ["session_id"], "native_order", "tool_name", "failed")
    return found.select("event_id", "session_id", "tool_name", "response")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS view_event_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts
""")
def asof_preceding_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    kind = lambda k: events.where(F.col("event_type") == k).drop("event_type")
    found = seq.asof_backward(kind("purchase"), kind("view").select("ts", "event_id", "user_id", "value"), ["user_id"], "ts", "ts", "view_")
    return found.select("event_id", "user_id", "view_event_id", "view_value")


@query("""
WITH s AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'signup'), c AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'),
r AS (SELECT s.event_id, c.event_id AS click, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(c.t - s.t), c.t, c.event_id) AS k
      FROM s JOIN c ON s.user_id = c.user_id AND abs(c.t - s.t) <= 50000)
SELECT s.event_id, s.user_id, r.click AS click_event_id FROM s LEFT JOIN r ON s.event_id = r.event_id AND r.k = 1
""")
def nearest_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", _seconds(F.col("ts")))
    kind = lambda k: events.where(F.col("event_type") == k).select("t", "event_id", "user_id")
    found = seq.nearest_within(kind("signup"), kind("click"), ["user_id"], "t", "t", 50000, "click_")
    return found.select("event_id", "user_id", "click_event_id")


@query("""
WITH m AS (SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id, ts,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events WHERE event_type = 'view')
SELECT m.event_id, m.user_id, CASE WHEN m.next_id IS NULL THEN NULL ELSE (SELECT count(*) FROM events e WHERE e.user_id = m.user_id AND e.event_type = 'purchase' AND e.ts > m.ts AND e.ts < m.next_ts) END AS changes
FROM m
""")
def changes_between_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return seq.changes_between(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], kind == "view", kind == "purchase").select("event_id", "user_id", "changes")


@query(f"""
WITH {OPERATIONS_SQL}, x AS (
  SELECT *, CASE WHEN failed AND lag(failed) OVER w AND lag(tool_name) OVER w = tool_name THEN 0 ELSE 1 END AS b,
         lead(event_id) OVER (PARTITION BY session_id, tool_name ORDER BY native_order) AS nid, lead(failed) OVER (PARTITION BY session_id, tool_name ORDER BY native_order) AS nf
  FROM operations WINDOW w AS (PARTITION BY session_id ORDER BY native_order)
), i AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY native_order ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT session_id, tool_name, count(*) AS failures, min(event_id) AS first_failure, max(event_id) AS last_failure, arg_max_null(nid, native_order) AS response,
       CASE WHEN arg_max_null(nid, native_order) IS NULL THEN 'none' WHEN arg_max(nf, native_order) THEN 'failed' ELSE 'passed' END AS next_outcome
FROM i WHERE failed GROUP BY session_id, tool_name, g
""")
def failure_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.failure_chains(operations(spark, sf_dir), ["session_id"], "native_order", "tool_name", "failed", "event_id")


@query(f"""
WITH {OPERATIONS_SQL}, r AS (
  SELECT event_id, session_id, tool_name, row_number() OVER w AS occurrence, first_value(event_id) OVER w AS first_id
  FROM operations WINDOW w AS (PARTITION BY session_id, tool_name, input_digest ORDER BY native_order)
)
SELECT * FROM r WHERE occurrence > 1
""")
def repeated_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.repeats(operations(spark, sf_dir), ["session_id"], ["native_order", "event_id"], ["tool_name", "input_digest"])
    return found.select("event_id", "session_id", "tool_name", "occurrence", "first_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "view", F.col("value"))
    return seq.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, "carried").select("event_id", "carried")


@query("SELECT event_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def running_token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    return seq.running_total(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, "total").select("event_id", F.round("total", 4).alias("total"))


@query("""
WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type FROM l WHERE n = 1 OR event_type IS DISTINCT FROM p
""")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.without_consecutive_duplicates(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("""
WITH e AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS episode FROM conversations)
SELECT conv_id, episode, count(*) AS units, count(*) FILTER (role = 'user') AS leads, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM e GROUP BY conv_id, episode
""")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.episodes(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    lead = F.count_if(F.col("role") == "user")
    return rows.groupBy("conv_id", "episode").agg(F.count("*").alias("units"), lead.alias("leads"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("""
WITH w AS (SELECT event_type, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS a FROM events)
SELECT event_type, count(*) FILTER (a) AS inside, count(*) FILTER (NOT a) AS outside, round(count(*) FILTER (a) / CAST(sum(count(*) FILTER (a)) OVER () AS DOUBLE), 9) AS share_inside,
       round(count(*) FILTER (NOT a) / CAST(sum(count(*) FILTER (NOT a)) OVER () AS DOUBLE), 9) AS share_outside
FROM w GROUP BY event_type
""")
def after_anchor_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.after_anchor(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 5)
    return units.inside_share(rows, "event_type", F.col("after_anchor"))


@query("""
WITH c AS (SELECT user_id, event_id, event_type = 'view' AS k, value < 20 AS f, event_type = 'purchase' AS h FROM events),
l AS (SELECT user_id, max(event_id) FILTER (k) AS last_check, max(event_id) FILTER (k AND NOT f) AS last_passed_check FROM c GROUP BY user_id)
SELECT *, CASE WHEN user_id % 4 = 0 THEN 'not-claimed' WHEN last_check IS NULL THEN 'no-captured-check' WHEN last_passed_check IS DISTINCT FROM last_check THEN 'contradicted-by-last-check'
            WHEN changes_after > 0 THEN 'changed-after-check' ELSE 'supported-by-last-check' END AS verdict
FROM (SELECT l.user_id, l.last_check, l.last_passed_check, count(c.event_id) FILTER (c.h AND c.event_id > l.last_check) AS changes_after,
             min(c.event_id) FILTER (c.h AND c.event_id > l.last_check) AS first_change_after
      FROM l JOIN c ON l.user_id = c.user_id GROUP BY l.user_id, l.last_check, l.last_passed_check)
""")
def last_run_and_changes_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = seq.last_checks(table(spark, sf_dir, "events"), ["user_id"], "event_id", kind == "view", F.col("value") < 20, kind == "purchase")
    return found.withColumn("verdict", seq.verdict(F.col("user_id") % 4 != 0, F.col("last_check"), F.col("last_passed_check"), F.col("changes_after")))


@query("""
SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6, 6) AS t_rel_seconds,
       round((epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6, 6) AS span_seconds FROM events
""")
def relative_time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = seq.relative_time(rows, ["user_id"], "at")
    return found.select("event_id", F.round("t_rel_seconds", 6).alias("t_rel_seconds"), F.round("span_seconds", 6).alias("span_seconds"))


@query("""
WITH l AS (SELECT event_id, user_id, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS o, lag(CAST(substr(props, 7, length(props) - 7) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_order FROM events)
SELECT event_id, user_id, o AS native_order, previous_order FROM l WHERE o < previous_order
""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations(spark, sf_dir).select("event_id", F.col("session_id").alias("user_id"), F.col("input_digest").alias("native_order"))
    return seq.order_violations(rows, ["user_id"], ["event_id"], "native_order")


@query(f"""
WITH {OPERATIONS_SQL}, c AS (SELECT session_id, input_digest, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS channel FROM operations),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, input_digest ORDER BY channel, event_id) AS k FROM c)
SELECT session_id, input_digest, event_id, channel FROM r WHERE k = 1
""")
def cross_source_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    rows = operations(spark, sf_dir).select("session_id", "input_digest", "event_id", channel.alias("channel"))
    return seq.first_per_key(rows, ["session_id", "input_digest"], [F.col("channel"), F.col("event_id")])


@query(f"""
WITH {OPERATIONS_SQL}, r AS (SELECT session_id, tool_name, input_digest AS rk, event_id, rank() OVER (PARTITION BY session_id, tool_name ORDER BY input_digest) AS k FROM operations)
SELECT session_id, tool_name, min(event_id) AS event_id FROM r WHERE k = 1 GROUP BY session_id, tool_name HAVING count(*) = 1
""")
def relation_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations(spark, sf_dir).select("session_id", "tool_name", F.col("input_digest").alias("rk"), "event_id")
    return seq.unique_lowest(rows, ["session_id", "tool_name"], "rk", "event_id")


@query(f"""
WITH RECURSIVE {OPERATIONS_SQL}, o AS (
  SELECT session_id, event_id, CASE WHEN event_type IN ('click', 'signup') THEN event_type || CAST(input_digest % 3 AS VARCHAR) END AS kind, failed AS breaks,
         row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS n FROM operations
), r AS (
  SELECT session_id, event_id, kind, breaks, n, CASE WHEN kind IS NULL THEN -1 ELSE 0 END AS number, CASE WHEN kind IS NULL THEN NULL ELSE [kind] END AS seen FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.event_id, o.kind, o.breaks, o.n, CASE WHEN o.kind IS NOT NULL AND (r.seen IS NULL OR list_contains(r.seen, o.kind)) THEN r.number + 1 ELSE r.number END,
         CASE WHEN o.kind IS NULL THEN CASE WHEN o.breaks THEN NULL ELSE r.seen END WHEN r.seen IS NULL OR list_contains(r.seen, o.kind) THEN [o.kind] ELSE list_append(r.seen, o.kind) END
  FROM o JOIN r ON o.session_id = r.session_id AND o.n = r.n + 1
)
SELECT session_id, event_id, kind, breaks, CAST(number AS BIGINT) AS boundary FROM r WHERE kind IS NOT NULL
""")
def compaction_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "signup"), F.concat(F.col("event_type"), (F.col("input_digest") % 3).cast("string")))
    rows = operations(spark, sf_dir).select("session_id", "event_id", kind.alias("kind"), F.col("failed").alias("breaks"))
    return seq.compaction_boundaries(rows, "session_id", ["event_id"]).where("boundary IS NOT NULL")


@query(f"""
WITH {OPERATIONS_SQL}, g AS (SELECT session_id AS run, tool_name, input_digest, min(native_order) AS started, max(native_order) AS ended, count(*) AS records, bool_or(failed) AS failed, count(DISTINCT event_type) AS kinds FROM operations GROUP BY ALL)
SELECT run AS session_id, tool_name, count(*) AS operations, count(*) FILTER (failed) AS failed_operations, CAST(sum(records) AS BIGINT) AS native_records, count(*) FILTER (kinds > 1) AS mixed FROM g GROUP BY run, tool_name
""")
def tool_operation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.operation_summary(units.group_operations(operations(spark, sf_dir), ["session_id", "tool_name", "input_digest"]), ["session_id", "tool_name"])


@query("""
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
i AS (SELECT *, sum(CASE WHEN role = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM t)
SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, count(*) AS chunks, min(turn) AS first_turn FROM i GROUP BY conv_id, island
""")
def merged_message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    changed = F.col("role") != F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = seq.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], changed)
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("chunks"), F.min("turn").alias("first_turn"))


@query("""
WITH RECURSIVE p AS (SELECT event_id AS id, CASE event_id % 500 WHEN 0 THEN NULL WHEN 497 THEN event_id + 2 ELSE event_id - 1 END AS parent FROM events),
r AS (SELECT id, id AS root, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.id, r.root, r.depth + 1 FROM p JOIN r ON p.parent = r.id)
SELECT p.id, r.root, CAST(r.depth AS BIGINT) AS depth, r.id IS NULL AS in_cycle FROM p LEFT JOIN r ON p.id = r.id
""")
def parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to 496 steps, and in every 500 events three that go round in a circle."""
    id = F.col("id")
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return units.roots(ids.withColumn("parent", F.when(id % 500 == 0, None).when(id % 500 == 497, id + 2).otherwise(id - 1)))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS context FROM events)
SELECT user_id, round(sum(value) FILTER (event_type = 'purchase'), 4) AS tokens, round(max(context), 4) AS max_context, count(*) FILTER (event_type = 'error') AS errors,
       floor(sum(value) FILTER (event_type = 'purchase') * 100 + 0.5) / 100 AS cost
FROM e GROUP BY user_id
""")
def token_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = seq.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.when(kind == "view", F.col("value")), "context")
    spent = F.sum(F.when(kind == "purchase", F.col("value")))
    return rows.groupBy("user_id").agg(F.round(spent, 4).alias("tokens"), F.round(F.max("context"), 4).alias("max_context"), F.count_if(kind == "error").alias("errors"), (F.floor(spent * 100 + 0.5) / 100).alias("cost"))


@query("""
WITH RECURSIVE c AS (SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + value * 3600 AS e FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS n FROM c),
r AS (
  SELECT user_id, event_id, s, e, n, 1 AS t, [e] AS ends FROM o WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, s, e, n, t, list_concat(list_concat(ends[1:t - 1], [e]), ends[t + 1:]) FROM (
    SELECT o.*, r.ends, coalesce(nullif(list_position(list_transform(r.ends, lambda x: x <= o.s), true), 0), len(r.ends) + 1) AS t FROM o JOIN r ON o.user_id = r.user_id AND o.n = r.n + 1
  )
)
SELECT user_id, event_id, s AS start, e AS "end", CAST(t - 1 AS BIGINT) AS track FROM r
""")
def overlapping_call_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", _seconds(F.col("ts")).alias("start"), (_seconds(F.col("ts")) + F.col("value") * 3600).alias("end"))
    return units.pack_tracks(rows, "user_id", "event_id")
