"""Queries of what validates evaluations: chained histories, linked citations, assertions, claims and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import calibration, evaluations
from tracemill.plans import claims
from tracemill.plans.registry import query
from tracemill.sources.tables import table


@query("""
WITH d AS (SELECT conv_id, turn, length(text) AS n, sha256(text) AS digest FROM conversations WHERE text IS NOT NULL),
h AS (SELECT *, sha256(coalesce(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS held,
             coalesce(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> '' AS later FROM d)
SELECT CAST(conv_id AS VARCHAR) AS log, CAST(turn AS BIGINT) AS idx FROM h WHERE n % 9 = 0 OR (n % 9 = 1 AND later)
""")
def history_links_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a log whose links are digests of all digests before; some claim another one, some that of an empty log."""
    from pyspark.sql import Window as W

    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))
    before = F.array_join(F.collect_list("digest").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), "")
    claimed = F.when(F.col("n") % 9 == 0, F.sha2(F.concat(before, F.lit("x")), 256)).when(F.col("n") % 9 == 1, F.sha2(F.lit(""), 256)).otherwise(F.sha2(before, 256))
    return calibration.history_breaks(turns.select(F.col("conv_id").cast("string").alias("log"), F.col("turn").cast("long").alias("idx"), "digest", claimed.alias("previous_history")))


_K = "CAST(substr(props, 7, length(props) - 7) AS BIGINT)"


@query(f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, event_type, {_K} AS k FROM events),
u AS (SELECT event_id AS unit, CASE WHEN k % 4 > 0 THEN 'e' || event_id END AS event, 'a' || user_id AS artifact, event_id AS line, 'k' || k % 5 AS kind, t FROM e WHERE event_type = 'view'),
c AS (SELECT event_id AS citation, CASE WHEN k % 2 = 0 THEN 'e' || (event_id - 1) END AS event, CASE WHEN k % 3 > 0 THEN 'a' || user_id ELSE 'none' END AS artifact, event_id AS line, 'k' || k % 5 AS kind, t FROM e WHERE event_type = 'purchase'),
l AS (SELECT c.citation, max(u.line) AS line FROM c JOIN u ON u.artifact = c.artifact AND u.line <= c.line GROUP BY c.citation),
n AS (SELECT c.citation, arg_min(u.unit, (abs(u.t - c.t), u.t, u.unit)) AS unit FROM c JOIN u ON u.kind = c.kind AND abs(u.t - c.t) <= 600000 GROUP BY c.citation)
SELECT c.citation, coalesce(x.unit, l.line, n.unit) AS unit, CASE WHEN x.unit IS NOT NULL THEN 'event' WHEN l.line IS NOT NULL THEN 'order' WHEN n.unit IS NOT NULL THEN 'time' END AS how
FROM c LEFT JOIN u x ON x.event = c.event LEFT JOIN l USING (citation) LEFT JOIN n USING (citation)
""")
def citations_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases cite the event before them, a place in their user's log, or a time; views are the units."""
    e = table(spark, sf_dir, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    common = (F.col("event_id").alias("line"), named("k", F.col("k") % 5).alias("kind"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"))
    units = e.where("event_type = 'view'").select(F.col("event_id").alias("unit"), F.when(F.col("k") % 4 > 0, named("e", F.col("event_id"))).alias("event"), named("a", F.col("user_id")).alias("artifact"), *common)
    cited = e.where("event_type = 'purchase'").select(F.col("event_id").alias("citation"), F.when(F.col("k") % 2 == 0, named("e", F.col("event_id") - 1)).alias("event"), F.when(F.col("k") % 3 > 0, named("a", F.col("user_id"))).otherwise("none").alias("artifact"), *common)
    return evaluations.link_citations(cited, units, 600_000)


@query("""
WITH a AS (
  SELECT o_orderkey AS assertion_id, CASE o_orderstatus WHEN 'F' THEN 'assessed' WHEN 'O' THEN 'abstained' ELSE 'guessed' END AS disposition,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'adverse' WHEN '2-HIGH' THEN 'mixed' WHEN '3-MEDIUM' THEN 'splendid' END AS assessment, o_totalprice > 300000 AS stale FROM orders
)
SELECT assertion_id, 'unknown-disposition' AS problem FROM a WHERE disposition = 'guessed'
UNION SELECT assertion_id, 'unknown-assessment' FROM a WHERE disposition = 'assessed' AND (assessment IS NULL OR assessment = 'splendid')
UNION SELECT assertion_id, 'abstention-with-assessment' FROM a WHERE disposition = 'abstained' AND assessment IS NOT NULL
UNION SELECT assertion_id, 'stale-digest' FROM a WHERE stale
UNION SELECT l_orderkey, 'citation-unresolved' FROM lineitem WHERE l_quantity > 45
UNION SELECT l.l_orderkey, 'claim-cites-beyond-assertion' FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_partkey = l.l_suppkey)
""")
def assertion_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assertions that cite their lines' parts; lines that came back claim something of their supplier's number."""
    status, priority, stale = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice") > 300000
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    asserted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assertion_id"), F.when(status == "F", "assessed").when(status == "O", "abstained").otherwise("guessed").alias("disposition"), F.when(priority == "1-URGENT", "adverse").when(priority == "2-HIGH", "mixed").when(priority == "3-MEDIUM", "splendid").alias("assessment"), digest.alias("digest"), F.when(stale, F.lit("other")).otherwise(digest).alias("rebuilt_digest"))
    lines = table(spark, sf_dir, "lineitem")
    key, event = F.col("l_orderkey").alias("assertion_id"), F.col("l_partkey").cast("string")
    cited = lines.select(key, event.alias("event_id"), (F.col("l_quantity") <= 45).alias("resolved"))
    claimed = lines.where("l_returnflag = 'R'").select(key, F.col("l_linenumber").alias("claim_id"), F.array(event, F.col("l_suppkey").cast("string")).alias("event_ids"))
    return evaluations.assertion_breaches(asserted, cited, claimed)


@query("""
WITH o AS (SELECT o_orderstatus AS s, count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY 1), n AS (SELECT string_agg('{"n":' || c || ',"name":"' || n_name || '"}', ',' ORDER BY n_name) AS t, count(*) AS k FROM (SELECT n_name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1))
SELECT 'cell' AS id, round((SELECT total FROM o WHERE s = 'F'), 2) AS found, NULL AS digest, true AS holds
UNION ALL SELECT 'share', round((SELECT CAST(sum(n) FILTER (s = 'O') AS DOUBLE) / sum(n) FILTER (s = 'O') FROM o), 2), NULL, true
UNION ALL SELECT 'no cell', NULL, NULL, false
UNION ALL SELECT 'pointer', (SELECT CAST(n AS DOUBLE) FROM o WHERE s = 'P'), NULL, true
UNION ALL SELECT 'no pointer', NULL, NULL, false
UNION ALL SELECT 'sql', (SELECT CAST(count(*) AS DOUBLE) FROM lineitem), NULL, true
UNION ALL SELECT 'several rows', NULL, NULL, false
UNION ALL SELECT 'receipt', (SELECT CAST(k AS DOUBLE) FROM n), (SELECT 'sha256:' || sha256('[' || t || ']') FROM n), true
""")
def claims_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a report against cells, pointers, SQL and a view's receipt, all from the tables."""
    for name in ("orders", "lineitem", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"claimed_{name}")
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total"))
    rows = {r["status"]: (r["n"], r["total"]) for r in cells.collect()}  # one row a status
    report = {"by/status": [{"~": s, "n": n} for s, (n, _) in sorted(rows.items())]}
    third = sorted(rows).index("P") if "P" in rows else len(rows)
    listed = [
        {"id": "cell", "cell": {"where": "status = 'F'", "value": "total"}, "expected": rows.get("F", (0, None))[1]},
        {"id": "share", "cell": {"where": "status = 'O'", "value": "n", "denominator": "n"}, "expected": 1.0},
        {"id": "no cell", "cell": {"where": "status = 'X'", "value": "n"}, "expected": 0},
        {"id": "pointer", "pointer": f"/by~1status/{third}/n", "expected": rows.get("P", (None, 0))[0]},
        {"id": "no pointer", "pointer": "/by~1status/01/n", "expected": 0},
        {"id": "sql", "sql": "SELECT count(*) FROM claimed_lineitem", "expected": table(spark, sf_dir, "lineitem").count()},
        {"id": "several rows", "sql": "SELECT o_orderkey FROM claimed_orders", "expected": 0},
    ]
    tolerance = 1e-9 * max([1.0, *(t for _, t in rows.values() if t)])
    checked = [(c["id"], None if c["found"] is None else round(float(c["found"]), 2), None, c["holds"]) for c in claims.check_claims(spark, listed, report, cells, tolerance)]
    given = claims.run_view(spark, {"claimed_sizes": "SELECT n_name AS name, count(c_custkey) AS n FROM claimed_nation LEFT JOIN claimed_customer ON c_nationkey = n_nationkey GROUP BY n_name"}, "SELECT * FROM claimed_sizes ORDER BY name")
    checked.append(("receipt", float(given["rows"]), given["digest"], True))
    return spark.createDataFrame(checked, "id string, found double, digest string, holds boolean")


@query(f"""
WITH e AS (SELECT user_id AS a, event_id AS n, event_type, {_K} AS k FROM events),
u AS (SELECT a, 'u' || a || '-' || k % 30 AS unit_id, CASE WHEN k % 30 < 20 THEN 'ep' || a || '-' || k % 3 END AS episode_id, n FROM e WHERE event_type IN ('view', 'error')),
p AS (SELECT unit_id, n FROM u UNION SELECT episode_id, n FROM u WHERE episode_id IS NOT NULL),
c AS (SELECT p.unit_id, 'j' || k % 40 AS j, min(CASE WHEN k % 2 = 0 THEN 'focus:adverse' ELSE 'focus:abstained' END) AS label FROM p JOIN e ON e.event_type = 'click' AND e.n - 1 = p.n GROUP BY ALL),
d AS (SELECT p.unit_id, string_agg(DISTINCT 'x' || k % 4, ' ' ORDER BY 'x' || k % 4) AS x FROM p JOIN e ON e.event_type = 'purchase' AND e.n - 1 = p.n GROUP BY p.unit_id),
g AS (SELECT unit_id, string_agg(j, ' ' ORDER BY j) AS js, string_agg(label, ' ' ORDER BY j) AS labels FROM c GROUP BY unit_id)
SELECT DISTINCT p.unit_id, coalesce(js, '') AS cited_assertions, coalesce(labels, '') AS cited_assessments, js IS NOT NULL AS cited, coalesce(x, '') AS extractors FROM p LEFT JOIN g USING (unit_id) LEFT JOIN d USING (unit_id)
""")
def units_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and errors in units and episodes; a click after one cites it, a purchase after one draws on it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("attempt_id"), F.col("event_id").alias("n"), "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    k, text = F.col("k"), lambda c: c.cast("string")
    of = e.where("event_type IN ('view', 'error')").select("attempt_id", "n", F.concat(F.lit("u"), "attempt_id", F.lit("-"), text(k % 30)).alias("unit_id"), F.when(k % 30 < 20, F.concat(F.lit("ep"), "attempt_id", F.lit("-"), text(k % 3))).alias("episode_id"))
    episodes = of.where("episode_id IS NOT NULL").select("attempt_id", F.col("episode_id").alias("unit_id"), F.lit("episode").alias("unit_kind"), F.lit(None).cast("string").alias("episode_id")).distinct()
    units = of.select("attempt_id", "unit_id", F.lit("tool").alias("unit_kind"), "episode_id").distinct().unionByName(episodes)
    after = lambda kind: e.where(F.col("event_type") == kind).select("attempt_id", text(F.col("n") - 1).alias("event_id"), "k")
    cites = after("click").join(of.select(text(F.col("n")).alias("event_id"), F.col("attempt_id").alias("a")), "event_id").select(F.col("a").alias("attempt_id"), "event_id", F.concat(F.lit("j"), text(k % 40)).alias("assertion_id"), F.when(k % 2 == 0, "focus:adverse").otherwise("focus:abstained").alias("label"))
    draws = after("purchase").join(of.select(text(F.col("n")).alias("event_id"), F.col("attempt_id").alias("a")), "event_id").select(F.col("a").alias("attempt_id"), "event_id", F.concat(F.lit("x"), text(k % 4)).alias("extractor_id"))
    found = evaluations.tagged_units(units, of.select("unit_id", text(F.col("n")).alias("event_id")), cites, draws)
    return found.select("unit_id", F.array_join("cited_assertions", " ").alias("cited_assertions"), F.array_join("cited_assessments", " ").alias("cited_assessments"), "cited", F.array_join("observation_extractors", " ").alias("extractors"))


@query("""
SELECT conv_id, turn, turn % 3 <> 2 AND length(text) % 2 = 0 AND length(text) % 5 < 4 AS silent FROM conversations WHERE text IS NOT NULL
""")
def silent_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's call (two for every third turn) that passed or not, with no output, a mark of none, or the turn's text."""
    size = F.length("text")
    output = F.when(size % 5 == 0, "").when(size % 5 == 1, " (no output) ").when(size % 5 == 2, "(Bash completed with no output)").when(size % 5 == 3, None).otherwise(F.concat(F.lit("no output: "), "text"))
    call = F.struct(F.when(size % 2 == 0, "passed").otherwise("failed").alias("result"), output.alias("output"))
    calls = F.when(F.col("turn") % 3 == 2, F.array(call, call)).otherwise(F.array(call))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", evaluations.silent_success(calls).alias("silent"))
