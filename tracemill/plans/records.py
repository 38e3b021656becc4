"""Queries over native records: normalization, occurrences, observations, units, decisions, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import evaluations, normalize, occurrences
from tracemill.plans.registry import query
from tracemill.sources.tables import table


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a record of one harness's stream: items and turns of a user's thread."""
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    kind = F.when(F.col("event_type") == "view", "commandExecution").when(F.col("event_type") == "click", "agentMessage").when(F.col("event_type") == "purchase", "fileChange").when(F.col("event_type") == "error", "commandExecution").otherwise("unknownItem")
    item = F.struct(kind.alias("type"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("cmd "), (F.col("k") % 7).cast("string")).alias("command"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 0).alias("exitCode"), F.lit("completed").alias("status"))
    doc = F.struct(F.col("event_id").alias("sequence"), F.lit("item/completed").alias("method"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("observedAt"), F.struct(F.col("user_id").cast("string").alias("threadId"), item.alias("item")).alias("payload"))
    user = F.col("user_id").cast("string")
    return e.select(user.alias("run_id"), user.alias("attempt_id"), F.lit("stdio").alias("artifact_id"), F.concat(F.lit("line:"), F.col("event_id").cast("string")).alias("locator"), F.lit("codex").alias("harness"), F.lit("session").alias("kind"), F.to_json(doc).alias("doc"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS attempt_id, CASE event_type WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'artifact' ELSE 'tool' END AS family,
       CASE event_type WHEN 'click' THEN 'agent' WHEN 'purchase' THEN 'agent' ELSE 'tool' END AS actor_kind, count(*) AS n
FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error') GROUP BY ALL
""")
def normalized_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(_native(spark, sf_dir)).groupBy("attempt_id", "family", "actor_kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS attempt_id, 'line:' || event_id AS locator, 'no uniform mapping for this native type' AS reason FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'error')")
def unmapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = _native(spark, sf_dir)
    return normalize.unmapped(native, normalize.normalize(native)).select("attempt_id", "locator", "reason")


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS attempt_id, event_id % 50 AS k, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error'))
SELECT attempt_id, 'id-not-unique' AS problem, 2 * count(*) AS n FROM e WHERE k = 1 GROUP BY attempt_id
UNION ALL SELECT attempt_id, 'undeclared-value', count(*) FROM e WHERE k = 2 GROUP BY attempt_id
UNION ALL SELECT attempt_id, 'reference-not-captured', count(*) FROM e WHERE k = 3 GROUP BY attempt_id
UNION ALL SELECT attempt_id, 'order-decreases', count(*) FROM e WHERE k = 4 AND p <> 4 GROUP BY attempt_id
""")
def adapter_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adapter's output with breaches of each kind planted."""
    native = _native(spark, sf_dir)
    events = normalize.normalize(native)
    k = F.regexp_extract("locator", "line:(\\d+)", 1).cast("long") % 50
    planted = events.withColumn("family", F.when(k == 2, "rumour").otherwise(F.col("family"))).withColumn("order_value", F.when(k == 4, F.lit(-1)).otherwise(F.col("order_value")))
    return normalize.breaches(planted.unionByName(planted.where(k == 1)), native.where(k != 3)).groupBy("attempt_id", "problem").agg(F.count("*").alias("n"))


_OPS = """
o AS (SELECT CAST(user_id AS VARCHAR) AS a, event_id AS n, 'cmd ' || CAST(substr(props, 7, length(props) - 7) AS BIGINT) % 7 AS d, event_type = 'error' AS f, ts FROM events WHERE event_type IN ('view', 'error'))"""


@query(f"""
WITH {_OPS}, x AS (SELECT *, CASE WHEN f AND lag(f) OVER w THEN 0 ELSE 1 END AS b FROM o WINDOW w AS (PARTITION BY a ORDER BY ts, n)),
i AS (SELECT *, sum(b) OVER (PARTITION BY a ORDER BY ts, n ROWS UNBOUNDED PRECEDING) AS g FROM x),
r AS (SELECT a, row_number() OVER (PARTITION BY a, d ORDER BY ts, n) AS k FROM o)
SELECT a AS attempt_id, 'failure-response' AS type, count(DISTINCT g) AS n FROM i WHERE f GROUP BY a
UNION ALL SELECT a, 'repeated-operation', count(*) FILTER (k > 1) FROM r GROUP BY a HAVING count(*) FILTER (k > 1) > 0
""")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences.occurrences(*occurrences.held(normalize.normalize(_native(spark, sf_dir))))
    return found.groupBy("attempt_id", "type").agg(F.count("*").alias("n"))


@query(f"""
WITH {_OPS}, s AS (SELECT *, lead(n) OVER (PARTITION BY a ORDER BY ts, n) AS nx FROM o), t AS (SELECT a, count(*) AS ops, count(*) FILTER (f) AS errors, count(*) FILTER (f AND nx IS NOT NULL) AS same FROM s GROUP BY a),
r AS (SELECT a, count(*) FILTER (k > 1) AS again FROM (SELECT a, row_number() OVER (PARTITION BY a, d ORDER BY n) AS k FROM o) GROUP BY a)
SELECT a AS attempt_id, 'tool-operation-count' AS extractor_id, 'known' AS status, CAST(ops AS DOUBLE) AS num FROM t UNION ALL SELECT a, 'tool-error-count', 'known', errors FROM t
UNION ALL SELECT a, 'failure-to-same-tool', 'known', same FROM t UNION ALL SELECT a, 'tool-repeated-count', 'known', again FROM r
""")
def structural_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences.observations(*occurrences.held(normalize.normalize(_native(spark, sf_dir))), F.lit("available"))
    wanted = ["tool-operation-count", "tool-error-count", "failure-to-same-tool", "tool-repeated-count"]
    return found.where(F.col("extractor_id").isin(wanted)).select("attempt_id", "extractor_id", "status", "num")


@query("""
SELECT CAST(user_id AS VARCHAR) AS attempt_id, CASE event_type WHEN 'click' THEN 'message' ELSE 'tool' END AS unit_kind, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed
FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL
""")
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, ops = occurrences.held(normalize.normalize(_native(spark, sf_dir)))
    rows = occurrences.units(events, ops, occurrences.occurrences(events, ops))
    return rows.groupBy("attempt_id", "unit_kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("""
WITH p AS (SELECT doc_id, quality * 0.5 + toxic * 0.5 AS s FROM labels)
SELECT CAST(doc_id AS VARCHAR) AS question, 'probabilities-do-not-sum-to-1' AS problem FROM p WHERE s <> 1
""")
def decision_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(F.lit("a"), F.lit("b"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("question"), F.lit("choice").alias("type"), options.alias("options"), F.lit("a").alias("choice"), F.lit(None).cast("double").alias("value"), F.create_map(F.lit("a"), F.col("quality") * 0.5, F.lit("b"), F.col("toxic") * 0.5).cast("map<string, double>").alias("probabilities"), F.lit(0.9).alias("confidence"))
    return evaluations.decision_breaches(rows)


@query("""
WITH a AS (SELECT l_orderkey AS occurrence, l_linenumber AS dimension, CASE l_returnflag WHEN 'A' THEN 'rule' WHEN 'R' THEN 'model' ELSE 'fallback' END AS source, l_discount * 10 AS confidence FROM lineitem),
r AS (SELECT *, CASE WHEN source = 'rule' THEN 0 WHEN source = 'model' AND confidence >= 0.8 THEN 1 WHEN source = 'fallback' THEN 2 ELSE 3 END AS k FROM a)
SELECT occurrence, dimension, CASE min(k) WHEN 0 THEN 'rule' WHEN 2 THEN 'fallback' ELSE 'model' END AS source, CASE WHEN min(k) = 3 THEN 'deferred' ELSE 'decided' END AS status FROM r GROUP BY occurrence, dimension
""")
def final_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("l_returnflag") == "A", "rule").when(F.col("l_returnflag") == "R", "model").otherwise("fallback")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("occurrence"), F.col("l_linenumber").alias("dimension"), source.alias("source"), F.lit("choice").alias("kind"), (F.col("l_discount") * 10).alias("confidence"), F.lit(None).cast("double").alias("probability"))
    return evaluations.final_ratings(rows).select("occurrence", "dimension", "source", "status")


@query("""
SELECT l_orderkey AS attempt_id, l_partkey AS event_id, p.p_partkey IS NOT NULL AS resolved, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON l_partkey = p.p_partkey GROUP BY ALL
""")
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations are counted first, so that each pair of attempt and event is joined once; no task gets many more than
    a million rows, however large the table."""
    lines, pair = table(spark, sf_dir, "lineitem"), ["attempt_id", "event_id"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // 1_000_000))
    cited = lines.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("event_id")).repartition(tasks, *pair).groupBy(*pair).agg(F.count("*").alias("n"))
    events = cited.join(table(spark, sf_dir, "part").where("p_size > 10"), F.col("event_id") == F.col("p_partkey"), "left_semi").select("attempt_id", F.col("event_id").alias("id"))
    return evaluations.resolved_citations(cited, events).select(*pair, "resolved", "n")
