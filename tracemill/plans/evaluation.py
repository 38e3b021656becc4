"""Queries over attempts: selection, metrics, comparison, filters, set invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.availability import capability_gate, histogram_text
from tracemill.operators import aggregation as agg
from tracemill.operators import comparison, filters, sets
from tracemill.plans.registry import query
from tracemill.sources.tables import ATTEMPTS_SQL, attempts, table

_DIMS = ["task_id", "model_id"]


@query(f"""
WITH {ATTEMPTS_SQL}, marked AS (
  SELECT *, attempt_number = max(attempt_number) OVER (PARTITION BY run_id) AS selected FROM attempts
)
SELECT task_id, model_id, count(*) FILTER (selected AND terminal_state = 'completed') AS completed,
       count(*) FILTER (selected) AS eligible, count(*) FILTER (NOT selected) AS not_selected,
       round(CAST(count(*) FILTER (selected AND terminal_state = 'completed') AS DOUBLE) / nullif(count(*) FILTER (selected), 0), 9) AS rate,
       CASE WHEN count(*) FILTER (selected) > 0 THEN 'available' ELSE 'unavailable' END AS status
FROM marked GROUP BY task_id, model_id
""")
def latest_attempt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = agg.grouped(agg.latest_per_run(attempts(spark, sf_dir)), _DIMS)
    done = F.count_if(F.col("selected") & (F.col("terminal_state") == "completed"))
    n = F.count_if("selected")
    rate = F.round(F.try_divide(F.col("completed"), F.col("eligible")), 9)
    status = F.when(F.col("eligible") > 0, "available").otherwise("unavailable")
    return marked.groupBy(*_DIMS).agg(done.alias("completed"), n.alias("eligible"), F.count_if(~F.col("selected")).alias("not_selected")).withColumn("rate", rate).withColumn("status", status)


@query(f"""
WITH {ATTEMPTS_SQL}, marked AS (
  SELECT *, attempt_number = max(attempt_number) OVER (PARTITION BY run_id) AS s FROM attempts
), g AS (
  SELECT harness_id, model_id, count(*) AS every, count(*) FILTER (s) AS n, count(*) FILTER (NOT s) AS skipped,
         count(*) FILTER (s AND capture_qualification IN ('qualified', 'qualified-with-gaps')) AS qualified,
         count(*) FILTER (s AND capture_qualification IS NOT NULL) AS captured,
         count(*) FILTER (s AND terminal_state = 'failed') AS failed, count(*) FILTER (s AND terminal_state = 'completed') AS completed
  FROM marked GROUP BY harness_id, model_id
), m AS (
  SELECT harness_id, model_id, 'attempt-count' AS metric, n AS numerator, every AS denominator, false AS has_rate,
         CASE WHEN skipped > 0 THEN 'not-selected-by-attempt-policy=' || skipped ELSE '' END AS exclusions FROM g
  UNION ALL SELECT harness_id, model_id, 'capture-qualified-rate', qualified, captured, true,
         CASE WHEN n > captured THEN 'capture-qualification-unavailable=' || (n - captured) ELSE '' END FROM g
  UNION ALL SELECT harness_id, model_id, 'infrastructure-failure-rate', failed, n, true, '' FROM g
  UNION ALL SELECT harness_id, model_id, 'terminal-completed-rate', completed, n, true, '' FROM g
)
SELECT harness_id, model_id, metric, CASE WHEN denominator > 0 THEN 'available' ELSE 'unavailable' END AS status,
       CASE WHEN denominator > 0 THEN CAST(numerator AS DOUBLE) END AS numerator, denominator,
       CASE WHEN has_rate AND denominator > 0 THEN round(CAST(numerator AS DOUBLE) / denominator, 9) END AS rate, exclusions
FROM m
""")
def attempt_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["harness_id", "model_id"]
    found = agg.attempt_metrics(agg.latest_per_run(attempts(spark, sf_dir)), dims)
    m = F.col("measurement")
    return found.select(*dims, "metric", m["status"].alias("status"), m["numerator"].alias("numerator"), m["denominator"].alias("denominator"), F.round(m["rate"], 9).alias("rate"), histogram_text(m["exclusions"]).alias("exclusions"))


@query(f"WITH {ATTEMPTS_SQL} SELECT run_id, attempt_id, attempt_number, trial_id FROM attempts WHERE harness_id = 'ASIA' AND model_id = 'BUILDING' AND terminal_state = 'completed'")
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.query_corpus(attempts(spark, sf_dir), harness="ASIA", model="BUILDING", terminal_state="completed")
    return found.select("run_id", "attempt_id", "attempt_number", "trial_id")


@query(f"""
WITH {ATTEMPTS_SQL}
SELECT facet, option FROM (
  SELECT DISTINCT 'harness_id' AS facet, harness_id AS option FROM attempts UNION SELECT DISTINCT 'model_id', model_id FROM attempts
  UNION SELECT DISTINCT 'task_id', task_id FROM attempts UNION SELECT DISTINCT 'terminal_state', terminal_state FROM attempts)
""")
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.facet_options(attempts(spark, sf_dir), ["harness_id", "model_id", "task_id", "terminal_state"])


@query("""
SELECT l_orderkey AS attempt_id, count(*) AS judgments, count(*) FILTER (l_returnflag = 'R') AS adverse
FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY l_orderkey
""")
def attempt_filter_keeps_all_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kept = filters.keep_whole_attempts(lines, (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "l_orderkey")
    return kept.groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.count("*").alias("judgments"), F.count_if(F.col("l_returnflag") == "R").alias("adverse"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), lower('Thereat'))")
def text_search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.free_text(table(spark, sf_dir, "documents"), ["source", "lang", "text"], "Thereat").select("doc_id", "lang", "source")


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS copies,
       count(DISTINCT concat_ws('|', l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate)) AS versions,
       CASE WHEN count(DISTINCT concat_ws('|', l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate)) > 1 THEN 'conflict' ELSE 'duplicate' END AS status
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def dedupe_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"])


@query(f"""
WITH {ATTEMPTS_SQL}
SELECT CASE WHEN capture_qualification IS NULL THEN 'capture-qualification-unavailable' WHEN capture_qualification IN ('incomplete', 'unqualified') THEN 'capture-' || capture_qualification END AS reason,
       count(*) AS count
FROM attempts WHERE capture_qualification IS NULL OR capture_qualification IN ('incomplete', 'unqualified') GROUP BY 1
""")
def exclusion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("capture_qualification")
    reason = F.when(c.isNull(), "capture-qualification-unavailable").when(c.isin("incomplete", "unqualified"), F.concat(F.lit("capture-"), c))
    return agg.exclusion_counts(attempts(spark, sf_dir), reason)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as three observations: a quantity, a status and a flag."""
    lines = table(spark, sf_dir, "lineitem").join(attempts(spark, sf_dir), F.col("l_orderkey") == F.col("attempt_id"))
    none = F.lit(None)
    shapes = [
        ("line-quantity", F.col("l_quantity").cast("double"), none.cast("boolean"), none.cast("string"), "piece"),
        ("line-open", none.cast("double"), F.col("l_linestatus") == "O", none.cast("string"), "line"),
        ("line-flag", none.cast("double"), none.cast("boolean"), F.col("l_returnflag"), "flag"),
    ]
    unknown = F.col("l_tax") > 0.07  # stands for a capture that lacks the line
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("extractor_id"), n.alias("num"), b.alias("bool"), s.alias("str"), F.lit(u).alias("unit")) for k, n, b, s, u in shapes)))
    rows = lines.select("attempt_id", "model_id", unknown.alias("__unknown"), each.alias("x"))
    hide = lambda c: F.when(~F.col("__unknown"), F.col(f"x.{c}")).alias(c)
    return rows.select("attempt_id", "model_id", "x.extractor_id", F.when(F.col("__unknown"), "unavailable").otherwise("known").alias("status"), hide("num"), hide("bool"), hide("str"), hide("unit"))


@query(f"""
WITH {ATTEMPTS_SQL}, o AS (
  SELECT a.model_id, l.l_quantity, l.l_linestatus, l.l_returnflag, l.l_tax > CAST(0.07 AS DOUBLE) AS unknown FROM lineitem l JOIN attempts a ON l.l_orderkey = a.attempt_id
)
SELECT model_id, 'line-quantity' AS extractor_id, NULL AS category, 'available' AS status, round(sum(l_quantity) FILTER (NOT unknown), 4) AS numerator, count(*) FILTER (NOT unknown) AS denominator, count(*) FILTER (unknown) AS excluded FROM o GROUP BY model_id
UNION ALL SELECT model_id, 'line-open', NULL, 'available', CAST(count(*) FILTER (NOT unknown AND l_linestatus = 'O') AS DOUBLE), count(*) FILTER (NOT unknown), count(*) FILTER (unknown) FROM o GROUP BY model_id
UNION ALL SELECT c.model_id, 'line-flag', c.l_returnflag, 'available', CAST(c.n AS DOUBLE), t.n, t.x
FROM (SELECT model_id, l_returnflag, count(*) AS n FROM o WHERE NOT unknown GROUP BY model_id, l_returnflag) c
JOIN (SELECT model_id, count(*) FILTER (NOT unknown) AS n, count(*) FILTER (unknown) AS x FROM o GROUP BY model_id) t USING (model_id)
""")
def structural_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.observation_metrics(_observations(spark, sf_dir), ["model_id"])
    return found.select("model_id", "extractor_id", "category", "status", F.round("numerator", 4).alias("numerator"), "denominator", "excluded")


@query("""
WITH j AS (SELECT p.p_type AS behavior, l.l_orderkey AS a, l.l_returnflag AS f FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
per AS (SELECT behavior, a, min(f) AS low, max(f) AS high FROM j GROUP BY behavior, a),
t AS (SELECT behavior, count(*) FILTER (low = high) AS denominator, count(*) FILTER (low <> high) AS conflicting FROM per GROUP BY behavior)
SELECT behavior, low AS assessment, count(*) AS numerator, t.denominator, t.conflicting, round(CAST(count(*) AS DOUBLE) / t.denominator, 9) AS rate
FROM per JOIN t USING (behavior) WHERE low = high GROUP BY behavior, low, t.denominator, t.conflicting
""")
def behavior_distribution_agreeing_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    judged = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("p_type").alias("behavior"), "l_orderkey", "l_returnflag")
    found = agg.behavior_distribution(judged, ["behavior"], "l_orderkey", "l_returnflag")
    return found.select("behavior", "assessment", "numerator", "denominator", "conflicting", F.round("rate", 9).alias("rate"))


@query(f"""
WITH {ATTEMPTS_SQL}, c AS (SELECT task_id, capture_qualification AS v, count(*) AS n FROM attempts GROUP BY 1, 2),
k AS (SELECT task_id, n, row_number() OVER (PARTITION BY task_id ORDER BY n DESC) AS r FROM c WHERE v IS NOT NULL)
SELECT t.task_id, count(k.n) AS distinct_values, coalesce(max(k.n) FILTER (k.r = 2), 0) AS second_most_frequent,
       coalesce((SELECT n FROM c WHERE c.task_id = t.task_id AND v IS NULL), 0) AS excluded,
       CASE WHEN count(k.n) = 0 THEN 'unavailable' WHEN coalesce(max(k.n) FILTER (k.r = 2), 0) = 0 THEN 'no-variation'
            WHEN max(k.n) FILTER (k.r = 2) >= 2 THEN 'recurring-description' ELSE 'case-study' END AS claim_status
FROM (SELECT DISTINCT task_id FROM attempts) t LEFT JOIN k ON k.task_id = t.task_id GROUP BY t.task_id
""")
def variation_second_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.variation(attempts(spark, sf_dir), ["task_id"], "capture_qualification")


@query(f"""
WITH {ATTEMPTS_SQL},
l AS (SELECT task_id, trial_id, started_at, count(*) AS n, min(cost) AS v FROM attempts WHERE model_id = 'BUILDING' GROUP BY ALL),
r AS (SELECT task_id, trial_id, started_at, count(*) AS n, min(cost) AS v FROM attempts WHERE model_id = 'MACHINERY' GROUP BY ALL),
u AS (SELECT coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn, r.v - l.v AS d FROM l FULL JOIN r USING (task_id, trial_id, started_at)),
m AS (SELECT CASE WHEN ln = 1 AND rn = 1 THEN d END AS d, CASE WHEN ln = 0 OR rn = 0 THEN 'u' WHEN ln > 1 OR rn > 1 THEN 'a' END AS why FROM u)
SELECT round(sum(d), 4) AS difference, count(d) AS matched_units, count(*) FILTER (d <> 0) AS differing_units, count(*) FILTER (why = 'u') AS unmatched,
       count(*) FILTER (why = 'a') AS ambiguous, CASE WHEN count(d) = 0 THEN 'unavailable' WHEN count(*) FILTER (d <> 0) = 0 THEN 'no-difference'
       WHEN count(*) FILTER (d <> 0) >= 2 THEN 'recurring-description' ELSE 'case-study' END AS claim_status
FROM m
""")
def matched_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    found = comparison.matched_difference(a.where("model_id = 'BUILDING'"), a.where("model_id = 'MACHINERY'"), ["task_id", "trial_id", "started_at"], "cost")
    return found.select(F.round("difference", 4).alias("difference"), "matched_units", "differing_units", F.col(f"`{comparison.UNMATCHED}`").alias("unmatched"), F.col(f"`{comparison.AMBIGUOUS}`").alias("ambiguous"), "claim_status")


@query(f"""
WITH {ATTEMPTS_SQL}, p AS (
  SELECT a.attempt_id AS l, b.attempt_id AS r, a.task_id <> b.task_id AS t, a.harness_id <> b.harness_id AS h, a.model_id <> b.model_id AS m
  FROM attempts a JOIN attempts b ON a.run_id = b.run_id + 1 AND a.attempt_number = 1 AND b.attempt_number = 1
)
SELECT l AS left_id, r AS right_id,
       concat_ws(',', CASE WHEN m THEN 'declared-model-difference' END, CASE WHEN t THEN 'task-mismatch' END, CASE WHEN h THEN 'undeclared-harness-difference' END) AS reasons,
       CASE WHEN t OR h THEN 'unsupported' WHEN m THEN 'supported-with-caveats' ELSE 'supported' END AS status
FROM p
""")
def comparison_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = attempts(spark, sf_dir).where("attempt_number = 1")
    candidate = F.struct(F.col("attempt_id").alias("id"), F.col("task_id").alias("task"), F.lit("f").alias("fixture"), F.lit("verified").alias("assessment_mode"), F.col("harness_id").alias("harness"), F.col("model_id").alias("model"), F.lit("1").alias("adapter_version"), F.array(F.lit("tool")).alias("capabilities"))
    one = first.select((F.col("run_id") - 1).alias("k"), candidate.alias("left"))
    two = first.select(F.col("run_id").alias("k"), candidate.alias("right"))
    pairs = one.join(two, "k").withColumn("required", F.array(F.lit("tool")))
    found = comparison.eligibility(pairs, declared=["model"])
    return found.select(F.col("left.id").alias("left_id"), F.col("right.id").alias("right_id"), F.array_join("reasons", ",").alias("reasons"), "status")


@query("SELECT count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o.o_orderkey")
def semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "lineitem").join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count("*").alias("lines"), F.sum("l_linenumber").alias("numbers"))


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def anti_unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'final' WHEN 'R' THEN 'snapshot' ELSE 'increment' END AS s, l_quantity AS q, l_shipdate AS d, l_partkey AS p FROM lineitem),
a AS (SELECT k, min(q) FILTER (s = 'final') AS lo, max(q) FILTER (s = 'final') AS hi, sum(q) FILTER (s = 'increment') AS inc,
      (arg_max(q, (epoch_us(d), p, q)) FILTER (s = 'snapshot')) AS snap FROM r GROUP BY k)
SELECT k AS l_orderkey, round(CASE WHEN lo <> hi THEN NULL ELSE coalesce(lo, snap, inc) END, 4) AS total,
       CASE WHEN lo <> hi THEN 'conflict' WHEN lo IS NOT NULL THEN 'final' WHEN snap IS NOT NULL THEN 'snapshot' WHEN inc IS NOT NULL THEN 'increments' ELSE 'missing' END AS basis,
       CASE WHEN (CASE WHEN lo <> hi THEN NULL ELSE coalesce(lo, snap, inc) END) IS NULL THEN 'unavailable' ELSE 'known' END AS status
FROM a
""")
def resource_semantics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantics = F.when(F.col("l_returnflag") == "A", "final").when(F.col("l_returnflag") == "R", "snapshot").otherwise("increment")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", semantics.alias("semantics"), F.col("l_quantity").alias("amount"), F.struct(F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("d"), F.col("l_partkey").alias("p")).alias("at"))
    return agg.resource_total(rows, ["l_orderkey"], "at").withColumn("total", F.round("total", 4))


@query("""
WITH s AS (SELECT count(DISTINCT o_custkey) AS runs, count(DISTINCT o_orderkey) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS selected, count(*) - count(DISTINCT o_orderkey) AS duplicates FROM orders)
SELECT * FROM s
""")
def source_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("attempt_id"), "o_orderstatus")
    return agg.source_population(o, F.col("o_orderstatus") == "F")


@query("SELECT event_type AS native_type, count(*) AS total, count(*) FILTER (value > 50) AS mapped, count(*) FILTER (NOT value > 50) AS unmapped FROM events GROUP BY event_type")
def native_type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.coverage(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50).withColumnRenamed("event_type", "native_type")


@query("""
WITH r AS (SELECT o_custkey AS run_id, o_orderstatus AS dimension, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS k FROM orders)
SELECT run_id, ['qualified', 'qualified-with-gaps', 'incomplete', 'unqualified'][max(k)] AS overall, count(DISTINCT dimension) AS dimensions FROM r GROUP BY run_id
""")
def worst_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderpriority") == "1-URGENT", "unqualified").when(F.col("o_orderpriority") == "2-HIGH", "incomplete").when(F.col("o_orderpriority") == "3-MEDIUM", "qualified-with-gaps").otherwise("qualified")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("dimension"), value.alias("value"))
    return agg.worst(rows, ["run_id"], "dimension", ["qualified", "qualified-with-gaps", "incomplete", "unqualified"], "value")


@query("""
WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(substr(props, 7, length(props) - 7) AS BIGINT) END AS r, event_type AS s FROM events),
i AS (SELECT user_id, r, count(DISTINCT s) AS n, count(*) AS c FROM e GROUP BY user_id, r)
SELECT user_id, CASE WHEN coalesce(sum(c) FILTER (r IS NULL), 0) = 0 THEN CAST(sum(greatest(1, n)) FILTER (r IS NOT NULL) AS BIGINT) END AS requests,
       CASE WHEN coalesce(sum(c) FILTER (r IS NULL), 0) > 0 THEN 'unavailable' ELSE 'known' END AS status
FROM i GROUP BY user_id
""")
def logical_request_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("CAST(substr(props, 7, length(props) - 7) AS BIGINT)")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", k).alias("request"), "event_type")
    return agg.request_count(rows, "user_id", "request", "event_type")


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n, CASE user_id % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'partial' ELSE 'unsupported' END AS cap FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN cap = 'unsupported' OR (cap = 'partial' AND n = 0) THEN 'unavailable' ELSE 'known' END AS status,
       CASE WHEN cap = 'unsupported' OR (cap = 'partial' AND n = 0) THEN NULL ELSE CAST(n AS DOUBLE) END AS value
FROM c
""")
def capability_gated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    capability = F.element_at(F.array(*map(F.lit, ["available", "partial", "unsupported"])), (F.col("user_id") % 3 + 1).cast("int"))
    return per.select("user_id", capability_gate(F.col("n"), capability).alias("v")).select("user_id", "v.status", "v.value")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS d, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE sha256(text) END AS d, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'unlisted' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.d <> b.d OR a.n <> b.n
""")
def manifest_verify_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("size"))
    listed = d.where("path % 5 <> 0").withColumn("digest", F.when(F.col("path") % 11 == 0, "stale").otherwise(F.col("digest")))
    return sets.verify_manifest(d.where("path % 7 <> 0"), listed)


@query("""
WITH s AS (SELECT doc_id AS p, sha256(text) AS d FROM documents WHERE doc_id % 4 <> 0), st AS (
  SELECT doc_id AS p, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(text) END AS d FROM documents WHERE doc_id % 6 <> 0
  UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 50 = 1),
g AS (SELECT p, count(*) AS n, min(d) AS d FROM st GROUP BY p)
SELECT coalesce(s.p, g.p) AS manifest_path, CASE WHEN g.p IS NULL THEN 'unindexed' WHEN s.p IS NULL THEN 'missing' WHEN g.n > 1 THEN 'duplicate' ELSE 'digest-mismatch' END AS issue
FROM s FULL JOIN g ON s.p = g.p WHERE g.p IS NULL OR s.p IS NULL OR g.n > 1 OR s.d <> g.d
""")
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("manifest_path"), F.sha2("text", 256).alias("digest"))
    stored = d.where("manifest_path % 6 <> 0")
    stored = stored.withColumn("digest", F.when(F.col("manifest_path") % 9 == 0, "x").otherwise(F.col("digest"))).unionByName(d.where("manifest_path % 6 <> 0 AND manifest_path % 50 = 1"))
    return sets.validate_index(d.where("manifest_path % 4 <> 0"), stored)


@query("""
SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources FROM (
  SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS src, 'part-of' AS rel FROM lineitem
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'child-of' FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'member-of' FROM customer) GROUP BY rel
""")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    parts = [
        sets.edges(lines, "event", F.concat_ws("/", "l_orderkey", "l_linenumber"), "part-of", "attempt", F.col("l_orderkey")),
        sets.edges(orders, "attempt", F.col("o_orderkey"), "child-of", "run", F.col("o_custkey")),
        sets.edges(customer, "run", F.col("c_custkey"), "member-of", "task", F.col("c_nationkey")),
    ]
    return sets.union_all(parts).groupBy("rel").agg(F.count("*").alias("edges"), F.count_distinct("src_id").alias("sources"))


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), m AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 25), u AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity < 26)
SELECT c.k AS key, CASE WHEN m.k IS NOT NULL AND u.k IS NOT NULL THEN 'mapped-and-unmapped' ELSE 'neither' END AS breach
FROM c LEFT JOIN m ON c.k = m.k LEFT JOIN u ON c.k = u.k WHERE (m.k IS NULL) = (u.k IS NULL)
""")
def uniform_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_quantity")
    return sets.partition_breaches(lines, lines.where("l_quantity > 25"), lines.where("l_quantity < 26"), "key")
