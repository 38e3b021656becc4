"""Queries over outcomes: retained observations, verifiers, reviews, bindings, recording grain, known intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import text
from tracemill.functions.availability import histogram_text
from tracemill.operators import aggregation as agg
from tracemill.operators import intervals, outcomes, vectors
from tracemill.plans.registry import query
from tracemill.sources.tables import ATTEMPTS_SQL, attempts, table

# the mode of a run and the capture of an attempt, some of them without evidence
_MODE = "CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'observational' WHEN 2 THEN 'unknown' END"
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'interrupted' END"
_CAPTURE = "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("attempt_id"), F.expr(_MODE).alias("assessment_mode"), F.expr(_STATE).alias("terminal_state"), F.expr(_CAPTURE).alias("capture_qualification"))


@query(f"""
WITH a AS (SELECT o_orderkey AS attempt_id, {_MODE} AS mode, {_STATE} AS state, {_CAPTURE} AS capture FROM orders),
w AS (SELECT l_orderkey AS attempt_id, count(*) AS named, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS found FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey),
x AS (SELECT * FROM a LEFT JOIN w USING (attempt_id))
SELECT attempt_id, 'assessment-mode' AS extractor_id, CASE WHEN coalesce(mode, 'unknown') = 'unknown' THEN NULL ELSE mode END AS str, CAST(NULL AS DOUBLE) AS num,
       CASE WHEN coalesce(mode, 'unknown') = 'unknown' THEN '{outcomes.NO_MODE}' END AS reason FROM x
UNION ALL SELECT attempt_id, 'terminal-state', state, NULL, CASE WHEN state IS NULL THEN '{outcomes.NO_TERMINAL}' END FROM x
UNION ALL SELECT attempt_id, 'capture-qualification', capture, NULL, CASE WHEN capture IS NULL THEN '{outcomes.NO_CAPTURE}' END FROM x
UNION ALL SELECT attempt_id, 'workspace-outcome-count', NULL, CASE WHEN found > 0 THEN found END, CASE WHEN named IS NULL THEN '{outcomes.NO_WORKSPACE}' WHEN found = 0 THEN '{outcomes.LOST_WORKSPACE}' END FROM x
""")
def outcome_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_suppkey").alias("workspace_id"), (F.col("l_returnflag") == "R").alias("retained"))
    return outcomes.outcome_observations(_outcomes(spark, sf_dir), named).select("attempt_id", "extractor_id", "str", "num", "reason")


@query("""
SELECT l_orderkey AS attempt_id, 'verifier-assertion-' || substr(sha256('part ' || l_partkey), 1, 16) AS extractor_id, CASE l_returnflag WHEN 'A' THEN 'passed' ELSE 'failed' END AS str
FROM lineitem WHERE l_orderkey % 4 = 0 AND l_returnflag <> 'N'
""")
def verifier_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "R", "failed")
    said = F.struct(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("id"), status.alias("status"))
    verifiers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.collect_list(said).alias("assertions"))
    return outcomes.verifier_observations(_outcomes(spark, sf_dir), verifiers).select("attempt_id", "extractor_id", "str")


@query(f"""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'mutation' WHEN 'view' THEN 'validation' END AS kind,
  CASE WHEN user_id % 5 = 1 AND event_id % 7 = 0 THEN NULL ELSE event_id END AS v, CASE WHEN user_id % 5 = 2 AND event_id % 2 = 0 THEN 'b' ELSE 'a' END AS d FROM events WHERE NOT (user_id % 5 = 3 AND event_type = 'purchase')),
p AS (SELECT user_id, count(*) FILTER (kind = 'mutation') AS m, max(v) FILTER (kind = 'mutation') AS lm, max(v) FILTER (kind = 'validation') AS lv,
  count(*) FILTER (kind IS NOT NULL AND v IS NULL) AS u, count(DISTINCT d) FILTER (kind IS NOT NULL) AS ds FROM e GROUP BY user_id),
r AS (SELECT *, CASE WHEN user_id % 5 = 4 THEN 'Required capability is partial.' WHEN m = 0 THEN '{outcomes.NO_MUTATION}' WHEN u > 0 OR ds <> 1 THEN '{outcomes.NO_ORDER}' END AS reason FROM p)
SELECT user_id AS attempt_id, CASE WHEN reason IS NULL THEN 'known' ELSE 'unavailable' END AS status, CASE WHEN reason IS NULL THEN coalesce(lv > lm, false) END AS value, reason FROM r
""")
def validation_after_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, id = F.col("user_id"), F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "mutation").when(F.col("event_type") == "view", "validation")
    rows = table(spark, sf_dir, "events").where(~((user % 5 == 3) & (F.col("event_type") == "purchase")))
    rows = rows.select(user.alias("attempt_id"), kind.alias("kind"), F.when(~((user % 5 == 1) & (id % 7 == 0)), id).alias("order_value"), F.when((user % 5 == 2) & (id % 2 == 0), "b").otherwise("a").alias("order_domain"))
    return outcomes.validation_after_mutation(rows, F.when(F.col("attempt_id") % 5 == 4, "partial").otherwise("available"))


def _metrics(found: DataFrame, dims: list[str]) -> DataFrame:
    m = F.col("measurement")
    return found.select(*dims, "metric", m["numerator"].alias("numerator"), m["denominator"].alias("denominator"), F.round(m["rate"], 9).alias("rate"), histogram_text(m["exclusions"]).alias("exclusions"))


_RATE = "CASE WHEN d > 0 THEN CAST(n AS DOUBLE) END AS numerator, d AS denominator, CASE WHEN d > 0 THEN round(CAST(n AS DOUBLE) / d, 9) END AS rate, x AS exclusions"


@query(f"""
WITH {ATTEMPTS_SQL}, a AS (
  SELECT model_id, attempt_number = max(attempt_number) OVER (PARTITION BY run_id) AS s, attempt_id % 4 = 0 AS verified, attempt_id % 3 AS v, attempt_id % 7 <> 0 AS observed FROM attempts
), g AS (
  SELECT model_id, count(*) FILTER (s) AS n, count(*) FILTER (s AND verified AND v <> 2) AS ok, count(*) FILTER (s AND verified AND v = 0) AS passed, count(*) FILTER (s AND NOT verified) AS other,
         count(*) FILTER (s AND observed) AS seen FROM a GROUP BY model_id
), m AS (
  SELECT model_id, 'verifier-pass-rate' AS metric, passed AS n, ok AS d, concat_ws(';', CASE WHEN other > 0 THEN 'observational-or-unknown-assessment-mode=' || other END,
         CASE WHEN n - ok - other > 0 THEN 'verifier-outcome-unavailable-or-infrastructure=' || (n - ok - other) END) AS x FROM g
  UNION ALL SELECT model_id, 'structural-observation-set-availability-rate', seen, n, CASE WHEN n > seen THEN 'observation-set-missing=' || (n - seen) ELSE '' END FROM g
)
SELECT model_id, metric, {_RATE} FROM m
""")
def verified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("attempt_id")
    said = F.when(id % 3 == 0, F.array(F.lit("passed"))).when(id % 3 == 1, F.array(F.lit("failed"))).otherwise(F.array(F.lit("passed"), F.lit("failed")))
    rows = agg.latest_per_run(attempts(spark, sf_dir)).withColumns({"assessment_mode": F.when(id % 4 == 0, "verified").when(id % 4 == 1, "observational"), "verifier_statuses": said, "observed": id % 7 != 0})
    return _metrics(outcomes.verified_metrics(rows, ["model_id"]), ["model_id"])


@query(f"""
WITH a AS (SELECT d.lang, l.doc_id % 11 = 0 AS abstained, CASE WHEN l.doc_id % 11 = 0 THEN 'judge-abstained' WHEN l.doc_id % 5 = 0 THEN 'unreviewed' WHEN l.quality = 1 AND l.toxic = 0 THEN 'confirmed' WHEN l.quality = 0 AND l.toxic = 0 THEN 'rejected' ELSE 'unresolved' END AS o,
  l.toxic = 1 AND l.quality = 0 AS disputed FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT lang, count(*) AS n, count(*) FILTER (abstained) AS abst, count(*) FILTER (o = 'confirmed') AS conf, count(*) FILTER (o IN ('confirmed', 'rejected', 'unresolved')) AS rev,
  count(*) FILTER (o IN ('unresolved', 'unreviewed', 'judge-abstained')) AS unres, count(*) FILTER (o = 'unreviewed') AS unrev, count(*) FILTER (disputed) AS disp FROM a GROUP BY lang),
m AS (SELECT lang, 'assertion-abstention-rate' AS metric, abst AS n, n AS d, '' AS x FROM g
UNION ALL SELECT lang, 'reviewed-assertion-confirmed-rate', conf, rev, concat_ws(';', CASE WHEN abst > 0 THEN 'judge-abstained=' || abst END, CASE WHEN unrev > 0 THEN 'unreviewed=' || unrev END) FROM g
UNION ALL SELECT lang, 'review-unresolved-rate', unres, n, '' FROM g UNION ALL SELECT lang, 'review-disputed-rate', disp, n, '' FROM g)
SELECT lang, metric, {_RATE} FROM m
""")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, good, bad = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    outcome = F.when(id % 11 == 0, "judge-abstained").when(id % 5 == 0, "unreviewed").when(good & ~bad, "confirmed").when(~good & ~bad, "rejected").otherwise("unresolved")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return _metrics(outcomes.review_metrics(rows.select("lang", (id % 11 == 0).alias("abstained"), outcome.alias("outcome"), (bad & ~good).alias("disputed")), ["lang"]), ["lang"])


@query("""
SELECT o_orderkey AS candidate, o_orderkey AS attempt_id FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 6 <> 0
""")
def bound_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt's own candidate; some attempts have no profile, some candidates another budget or adapter."""
    id = F.col("o_orderkey")
    fields = {c: F.concat(F.lit(c), (id % 5).cast("string")) for c in outcomes.BINDING} | {"run_id": id.cast("string"), "fixture_id": F.lit(None).cast("string"), "adapter_version": F.lit("1"), "capability_profile": F.lit("{}")}
    orders = table(spark, sf_dir, "orders")
    own = orders.select(id.alias("attempt_id"), *(v.alias(k) for k, v in (fields | {"capability_profile": F.when(id % 17 != 0, "{}")}).items()))
    asked = orders.select(id.alias("candidate"), *(v.alias(k) for k, v in (fields | {"budget_digest": F.when(id % 9 != 0, fields["budget_digest"]), "adapter_version": F.when(id % 6 == 0, "2").otherwise("1")}).items()))
    return outcomes.bound_candidates(asked, own)


@query(f"""
WITH {ATTEMPTS_SQL}, c AS (SELECT l_orderkey AS attempt_id, count(*) AS records, count(*) FILTER (l_returnflag = 'R') AS unmapped, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
a AS (SELECT model_id, records, unmapped, CASE WHEN attempt_id % 3 = 0 THEN q END AS q FROM attempts LEFT JOIN c USING (attempt_id))
SELECT model_id, 'records' AS measure, CAST(floor(avg(records) + 0.5) AS BIGINT) AS mean FROM a GROUP BY model_id
UNION ALL SELECT model_id, 'unmapped', CAST(floor(avg(unmapped) + 0.5) AS BIGINT) FROM a GROUP BY model_id UNION ALL SELECT model_id, 'q', CAST(floor(avg(q) + 0.5) AS BIGINT) FROM a GROUP BY model_id
""")
def recording_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.count("*").alias("records"), F.count_if(F.col("l_returnflag") == "R").alias("unmapped"), F.sum("l_quantity").alias("q"))
    rows = attempts(spark, sf_dir).join(per, "attempt_id", "left").withColumn("q", F.when(F.col("attempt_id") % 3 == 0, F.col("q")))
    return outcomes.recording_grain(rows, "model_id", ["records", "unmapped", "q"])


@query(f"""
WITH {ATTEMPTS_SQL}, n AS (SELECT model_id, count(*) AS lanes FROM attempts GROUP BY model_id),
t AS (SELECT model_id, p_type AS type, count(*) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN attempts ON l_orderkey = attempt_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY total DESC, type) AS rank FROM t)
SELECT model_id, CAST(rank AS INTEGER) AS rank, type, CAST(floor(CAST(total AS DOUBLE) / lanes + 0.5) AS BIGINT) AS mean FROM r JOIN n USING (model_id) WHERE rank <= 3
""")
def largest_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy(F.col("l_orderkey").alias("attempt_id"), F.col("p_type").alias("type")).agg(F.count("*").alias("n"))
    return outcomes.largest_types(counts, attempts(spark, sf_dir), "model_id")


@query("""
WITH e AS (SELECT user_id, event_id AS id, 'd' || (event_id % 2) AS d, CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) // 1000 END AS t, event_type = 'purchase' AS c, event_type FROM events),
p AS (SELECT user_id, d, lag(id) OVER w AS f, id AS o FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id, d ORDER BY id)),
x AS (SELECT p.user_id, p.f, p.o, count(c.id) AS n,
        count(*) FILTER (c.d <> p.d AND (c.t IS NULL OR ef.t IS NULL OR eo.t IS NULL OR c.t = ef.t OR c.t = eo.t)) AS unknown,
        count(*) FILTER ((c.d = p.d AND c.id > p.f AND c.id < p.o) OR (c.d <> p.d AND c.t > ef.t AND c.t < eo.t)) AS between_
      FROM p JOIN e ef ON ef.id = p.f JOIN e eo ON eo.id = p.o LEFT JOIN (SELECT * FROM e WHERE c) c ON c.user_id = p.user_id GROUP BY ALL)
SELECT user_id, f AS from_id, o AS to_id, CASE WHEN unknown = 0 THEN between_ END AS changes FROM x
""")
def known_changes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", id.alias("id"), F.concat(F.lit("d"), (id % 2).cast("string")).alias("domain"), id.alias("value"), F.when(id % 97 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("time"), (F.col("event_type") == "purchase").alias("change"), "event_type")
    before = F.lag("id").over(W.partitionBy("user_id", "domain").orderBy("id"))
    pairs = rows.where("event_type = 'view'").select("user_id", before.alias("from_id"), F.col("id").alias("to_id")).where("from_id IS NOT NULL")
    return outcomes.known_changes_between(rows.drop("event_type"), "user_id", pairs)


@query("""
WITH e AS (SELECT user_id, event_id AS id, 'd' || (event_id % 3) AS d, event_id // 2 AS v, CASE WHEN event_id % 9973 <> 0 THEN epoch_us(ts) // 60000000 + 7 * (event_id % 3) END AS t, event_type = 'purchase' AS c, event_type FROM events),
p AS (SELECT user_id, lag(id) OVER w AS f, id AS o FROM e WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY id)),
x AS (
  SELECT p.user_id, p.f, p.o, CASE WHEN c.id IS NULL THEN 9 WHEN c.id = ef.id THEN 0 WHEN c.d = ef.d THEN CASE WHEN c.v <> ef.v THEN sign(c.v - ef.v) END WHEN c.t <> ef.t THEN sign(c.t - ef.t) END AS after,
         CASE WHEN c.id IS NULL THEN 9 WHEN c.id = eo.id THEN 0 WHEN c.d = eo.d THEN CASE WHEN c.v <> eo.v THEN sign(eo.v - c.v) END WHEN c.t <> eo.t THEN sign(eo.t - c.t) END AS before
  FROM p JOIN e ef ON ef.id = p.f JOIN e eo ON eo.id = p.o LEFT JOIN (SELECT * FROM e WHERE c) c ON c.user_id = p.user_id
)
SELECT user_id, f AS from_id, o AS to_id, CASE WHEN count(*) = count(after) AND count(*) = count(before) THEN count(*) FILTER (after = 1 AND before = 1) END AS changes FROM x GROUP BY ALL
""")
def changes_across_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring views and clicks of a user, two of three in different domains; values tie, times jump between domains."""
    id = F.col("event_id")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) + 7 * (id % 3)
    rows = table(spark, sf_dir, "events").select("user_id", id.alias("id"), F.concat(F.lit("d"), (id % 3).cast("string")).alias("domain"), F.floor(id / 2).alias("value"), F.when(id % 9973 != 0, minute).alias("time"), (F.col("event_type") == "purchase").alias("change"), "event_type")
    before = F.lag("id").over(W.partitionBy("user_id").orderBy("id"))
    pairs = rows.where("event_type IN ('view', 'click')").select("user_id", before.alias("from_id"), F.col("id").alias("to_id")).where("from_id IS NOT NULL")
    return intervals.changes_between(rows.drop("event_type"), "user_id", pairs)


@query("SELECT doc_id, split_part(source, '-', 2) AS arm FROM (SELECT doc_id, 'run-' || lang || '-' || doc_id AS source FROM documents)")
def condition_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("run-"), "lang", F.lit("-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.named_group(name, r"^(run)-(?<condition>[a-z]+)-(\d+)$").alias("arm"))


@query("""
SELECT event_id, CASE event_type WHEN 'signup' THEN 'compaction' WHEN 'click' THEN 'edit:shell:src/a.ts' WHEN 'view' THEN 'read:cat:' WHEN 'error' THEN 'check:npm test' ELSE 'other:?' END AS signature FROM events
""")
def action_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    of = lambda **values: F.coalesce(*(F.when(kind == k, v) for k, v in values.items()))
    signature = text.action_signature(
        F.when(kind == "signup", "compaction").otherwise("tool"), of(click="edit", view="read", error="check", purchase="other", signup="other"), of(view="cat", error="npm test", click=""),
        of(click="shell", view="read", error="shell"), of(click="src/a.ts", error="x.ts"),
    )
    return table(spark, sf_dir, "events").select("event_id", signature.alias("signature"))


# units with the sentences that they are embedded as: kind, role, text, tool kind, tool, head, checks, writes, target, lines, status, error, seconds
_UNITS = [
    (("message", "user", "do it", "", "", "", "", "", "", 0, "ok", "", 0), "do it"),
    (("message", "harness", "x", "", "", "", "", "", "", 0, "ok", "", 90), "[injected by harness] x"),
    (("compaction", "", "", "", "", "", "", "", "", 0, "ok", "", 0), "context compacted"),
    (("compaction", "", "kept", "", "", "", "", "", "", 0, "ok", "", 0), "context compacted: kept"),
    (("delegation", "", "", "", "", "", "", "", "", 0, "ok", "", 0), "delegation event: delegation"),
    (("tool", "", "", "shell", "Bash", "pnpm test", "test,lint", "", "", 0, "error", "exit <n>", 31), "run `pnpm test` (test + lint) — failed: exit <n> [long-running]"),
    (("tool", "", "", "shell", "Bash", "", "", "src/app/a.ts,b.md", "", 0, "ok", "", 5), "run `Bash` — writes src/app/*.ts (+1 more)"),
    (("tool", "", "", "edit", "Edit", "", "", "", "src/a.test.ts", 40, "ok", "", 0), "edit src/*.ts (test) (medium edit)"),
    (("tool", "", "", "read", "Read", "", "", "", "", 0, "error", "", 0), "read a file — failed"),
    (("tool", "", "", "search", "Grep", "", "", "", "", 0, "ok", "", 0), "search the repository"),
    (("tool", "", "", "plan", "TodoWrite", "", "", "", "", 0, "ok", "", 0), "update the task plan"),
    (("tool", "", "", "web", "", "", "", "", "", 0, "ok", "", 0), "use tool unknown"),
]


@query("SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{want}'" for k, (_, want) in enumerate(_UNITS)) + " END AS sentence FROM events")
def unit_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "unit_kind role text tool_kind tool_name command_head check_kinds writes target lines_changed status error_signature duration_seconds".split()
    at = (F.col("event_id") % len(_UNITS) + 1).cast("int")
    u = {n: F.element_at(F.array(*(F.lit(row[k]) for row, _ in _UNITS)), at) for k, n in enumerate(names)}
    empty_is_null = lambda c: F.when(c != "", c)
    u |= {n: empty_is_null(u[n]) for n in ("tool_name", "command_head", "target", "error_signature")}
    u |= {n: F.filter(F.split(u[n], ","), lambda x: x != "") for n in ("check_kinds", "writes")}
    u |= {"summary": F.lit(None).cast("string"), "subkind": F.lit(None).cast("string")}
    return table(spark, sf_dir, "events").select("event_id", text.embed_text(u).alias("sentence"))


@query("""
WITH r AS (SELECT c_nationkey AS cluster, c_acctbal AS x, CAST(c_custkey % 101 AS DOUBLE) AS y, count(*) OVER (PARTITION BY c_nationkey) AS n,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS i, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 101) - 1 AS j FROM customer)
SELECT cluster, max(x) FILTER (i = n // 2) AS label_x, max(y) FILTER (j = n // 2) AS label_y, count(*) AS priority FROM r GROUP BY cluster
""")
def label_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 101).cast("double").alias("y"))
    return vectors.label_positions(points, "cluster", "x", "y")
