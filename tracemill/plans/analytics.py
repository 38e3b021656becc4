"""Queries over reviews, clusters, vectors, samples and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import calibration, enrichment, layout, sampling, vectors
from tracemill.plans.registry import query
from tracemill.sources.tables import ATTEMPTS_SQL, attempts, table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(attempts(spark, sf_dir), F.col("l_orderkey") == F.col("attempt_id"))
    return rows.select(F.col("p_type").alias("family"), F.col("p_brand").alias("cluster_id"), F.col("model_id").alias("condition"), F.col("l_orderkey").alias("attempt_id"), F.col("harness_id").alias("stratum"))


def _cluster_sql(stratum: str) -> str:
    return f"""
WITH {ATTEMPTS_SQL}, pop AS (
  SELECT p.p_type AS family, p.p_brand AS cluster_id, a.model_id AS condition, a.attempt_id, {stratum} AS stratum
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN attempts a ON l.l_orderkey = a.attempt_id),
f AS (SELECT family, stratum, count(*) AS n_f FROM pop GROUP BY ALL), fa AS (SELECT family, stratum, condition, count(*) AS n_fa FROM pop GROUP BY ALL),
cl AS (SELECT family, cluster_id, count(*) AS n_total FROM pop GROUP BY ALL), cs AS (SELECT cluster_id, stratum, count(*) AS n_c FROM pop GROUP BY ALL),
ca AS (SELECT cluster_id, condition, count(*) AS o, count(DISTINCT attempt_id) AS k FROM pop GROUP BY ALL), arm AS (SELECT condition, count(DISTINCT attempt_id) AS k_arm FROM pop GROUP BY ALL),
r AS (SELECT cl.family, cl.cluster_id, fa.stratum, fa.condition, coalesce(ca.o, 0) AS o, coalesce(ca.k, 0) AS k, arm.k_arm,
             CAST(coalesce(cs.n_c, 0) AS DOUBLE) * fa.n_fa / f.n_f AS e, CAST(coalesce(cs.n_c, 0) AS DOUBLE) / f.n_f AS p, CAST(fa.n_fa AS DOUBLE) / f.n_f AS q
      FROM cl JOIN fa USING (family) JOIN f ON f.family = fa.family AND f.stratum = fa.stratum LEFT JOIN arm ON arm.condition = fa.condition
      LEFT JOIN cs ON cs.cluster_id = cl.cluster_id AND cs.stratum = fa.stratum LEFT JOIN ca ON ca.cluster_id = cl.cluster_id AND ca.condition = fa.condition)
SELECT family, cluster_id, stratum, condition, o, k, k_arm, round(e, 6) AS expected,
       round(CASE WHEN e * (1 - p) * (1 - q) > 0 THEN (o - e) / sqrt(e * (1 - p) * (1 - q)) ELSE 0 END, 6) AS z FROM r
"""


def _cluster(spark: SparkSession, sf_dir: str, stratified: bool) -> DataFrame:
    found = enrichment.cluster_arm(_units(spark, sf_dir), stratified, size=table(spark, sf_dir, "lineitem").count())
    return found.select("family", "cluster_id", "stratum", "condition", "o", "k", "k_arm", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"))


@query(_cluster_sql("''"))
def cluster_arm_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, False)


@query(_cluster_sql("a.harness_id"))
def cluster_arm_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, True)


@query(f"""
WITH {ATTEMPTS_SQL}, n AS (SELECT a.model_id, a.attempt_id, l.l_returnflag AS c, count(*) AS n FROM lineitem l JOIN attempts a ON l.l_orderkey = a.attempt_id GROUP BY ALL),
t AS (SELECT model_id, count(DISTINCT attempt_id) AS attempts FROM n GROUP BY model_id)
SELECT n.model_id, n.c AS category, t.attempts, CAST(sum(n.n) AS BIGINT) AS total, round(CAST(sum(n.n) AS DOUBLE) / t.attempts, 9) AS mean,
       CASE WHEN count(*) < t.attempts THEN 0 ELSE min(n.n) END AS least, max(n.n) AS most FROM n JOIN t USING (model_id) GROUP BY n.model_id, n.c, t.attempts
""")
def arm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(attempts(spark, sf_dir), F.col("l_orderkey") == F.col("attempt_id"))
    found = enrichment.arm_totals(rows.select("attempt_id", "model_id", F.col("l_returnflag").alias("category")), "attempt_id", "model_id", "category")
    return found.withColumn("mean", F.round("mean", 9))


@query("""
WITH s AS (SELECT o_orderpriority AS arm, 'item ' || l_linenumber || ' ' || l_returnflag AS signature, count(*) AS n, count(DISTINCT l_orderkey) AS attempts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n DESC, signature) AS rank FROM s)
SELECT * FROM r WHERE rank <= 3
""")
def failure_signatures_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    signature = F.concat_ws(" ", F.lit("item"), "l_linenumber", "l_returnflag")
    counts = rows.groupBy(F.col("o_orderpriority").alias("arm"), signature.alias("signature")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("attempts"))
    return enrichment.top_k(counts, ["arm"], [F.desc("n"), "signature"], 3)


@query("""
SELECT d.source AS category, d.lang AS arm, count(*) FILTER (l.quality = 0) AS q0, count(*) FILTER (l.quality = 1) AS q1 FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL
""")
def behavior_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("category"), F.col("lang").alias("arm"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("outcome"))
    return calibration.behavior_matrix(rows, "category", "arm", "outcome", ["q0", "q1"])


@query("""
SELECT d.lang AS category, count(*) AS selected, count(*) FILTER (l.quality IS NOT NULL AND l.toxic IS NOT NULL) AS denominator, count(*) FILTER (l.quality = l.toxic) AS agreements,
       count(*) FILTER (l.quality <> l.toxic) AS disagreements, round(CAST(count(*) FILTER (l.quality = l.toxic) AS DOUBLE) / count(*), 9) AS rate, 'available' AS status
FROM labels l JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.lang)
""")
def agreement_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id")
    return calibration.agreement(rows, "category", "quality", "toxic").withColumn("rate", F.round("rate", 9))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a decision about its order: the supplier's residue reviews, a few adjudicate."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assertion"), (F.col("l_suppkey") % 3).alias("reviewer"), F.when(F.col("l_partkey") % 9 == 0, "adjudication").otherwise("review").alias("kind"), "l_returnflag", "l_quantity", F.struct(F.unix_micros(F.col("l_shipdate").cast("timestamp")), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("o"))
    from pyspark.sql import Window as W

    state = F.when(F.col("l_returnflag") == "A", "rejected").when(F.col("l_returnflag") == "R", "disputed").when(F.col("l_quantity") > 45, "insufficient-evidence").otherwise("confirmed")
    return rows.select("assertion", "reviewer", "kind", state.alias("state"), F.row_number().over(W.partitionBy("assertion").orderBy("o")).cast("long").alias("idx"))


_DECISIONS_SQL = """
d AS (SELECT l_orderkey AS assertion, l_suppkey % 3 AS reviewer, CASE WHEN l_partkey % 9 = 0 THEN 'adjudication' ELSE 'review' END AS kind,
             CASE WHEN l_returnflag = 'A' THEN 'rejected' WHEN l_returnflag = 'R' THEN 'disputed' WHEN l_quantity > 45 THEN 'insufficient-evidence' ELSE 'confirmed' END AS state,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY epoch_us(l_shipdate), l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx FROM lineitem),
lr AS (SELECT * FROM d WHERE kind = 'review' QUALIFY row_number() OVER (PARTITION BY assertion, reviewer ORDER BY idx DESC) = 1)"""


@query(f"""
WITH {_DECISIONS_SQL},
o AS (SELECT assertion, max(idx) FILTER (kind = 'review') AS rv, max(idx) FILTER (kind = 'adjudication') AS aj, arg_max(state, idx) FILTER (kind = 'adjudication') AS st FROM d GROUP BY assertion),
r AS (SELECT assertion, count(*) FILTER (state IN ('disputed', 'insufficient-evidence')) AS op, count(*) FILTER (state = 'disputed') AS ds, count(DISTINCT state) AS ns, min(state) AS one,
             count(DISTINCT state) FILTER (state <> 'insufficient-evidence') AS nc FROM lr GROUP BY assertion),
c AS (SELECT o_orderkey AS assertion, o_orderstatus = 'P' AS abstained FROM orders),
x AS (SELECT c.assertion, c.abstained, CASE WHEN o.aj > coalesce(o.rv, -1) THEN o.st END AS a, o.rv, r.* EXCLUDE (assertion) FROM c LEFT JOIN o USING (assertion) LEFT JOIN r USING (assertion)),
y AS (SELECT *, CASE WHEN abstained THEN 'judge-abstained' WHEN a IN ('confirmed', 'rejected') THEN a WHEN a IS NOT NULL THEN 'unresolved' WHEN rv IS NULL THEN 'unreviewed'
                     WHEN op > 0 OR ns <> 1 THEN 'unresolved' ELSE one END AS outcome FROM x)
SELECT assertion, abstained, outcome, outcome = 'unresolved' AND coalesce(CASE WHEN a IS NOT NULL THEN a = 'disputed' ELSE ds > 0 OR nc > 1 END, false) AS disputed FROM y
""")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assertion"), (F.col("o_orderstatus") == "P").alias("abstained"))
    return calibration.review_outcomes(candidates, _decisions(spark, sf_dir))


@query(f"""
WITH {_DECISIONS_SQL}, v AS (SELECT * FROM lr WHERE state <> 'insufficient-evidence')
SELECT assertion, (SELECT count(*) FROM v a JOIN v b ON a.assertion = b.assertion AND a.reviewer < b.reviewer WHERE a.assertion = g.assertion) AS pairs,
       (SELECT count(*) FROM v a JOIN v b ON a.assertion = b.assertion AND a.reviewer < b.reviewer AND a.state = b.state WHERE a.assertion = g.assertion) AS agreements
FROM (SELECT DISTINCT assertion FROM v) g
""")
def human_human_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.human_pairs(_decisions(spark, sf_dir))


@query("""
WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', 'seed-1', lang, doc_id, sha256(text))), doc_id) AS draw FROM documents)
SELECT doc_id, lang, draw FROM k WHERE draw <= 20
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents"), "lang", 20, "seed-1", "doc_id", F.sha2("text", 256)).select("doc_id", "lang", "draw")


@query("SELECT n_name AS task_id, p_brand AS model_id, r_name AS harness_id, t.trial_id FROM nation, (SELECT DISTINCT p_brand FROM part), region, (SELECT unnest([1, 2, 3]) AS trial_id) t")
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c, n: table(spark, sf_dir, t).select(F.col(c).alias(n)).distinct()
    return sampling.run_matrix(one("nation", "n_name", "task_id"), one("part", "p_brand", "model_id"), one("region", "r_name", "harness_id"), 3)


@query("""
WITH g AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS f FROM nation)
SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY r, f, n_regionkey) - 1 AS position FROM g
""")
def balanced_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.interleave(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", ["n_nationkey"])


@query("""
WITH RECURSIVE q AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier), n AS (SELECT count(*) AS n FROM q),
f AS (
  SELECT n - 1 AS k, CAST('0x' || substr(sha256('queue-seed'), 1, 8) AS BIGINT) AS s, range(n) AS o FROM n
  UNION ALL
  SELECT k - 1, s, list_transform(range(len(o)), lambda i: CASE i WHEN k THEN o[j + 1] WHEN j THEN o[k + 1] ELSE o[i + 1] END) FROM (
    SELECT k, o, s, s % (k + 1) AS j FROM (SELECT k, o, xor(s, (s << 5) & 4294967295) AS s FROM (SELECT k, o, xor(s, s >> 17) AS s FROM (SELECT k, o, xor(s, (s << 13) & 4294967295) AS s FROM f WHERE k > 0)))
  )
)
SELECT q.s_suppkey, p.position FROM (SELECT unnest(o) AS k, unnest(range(len(o))) AS position FROM f WHERE k = 0) p JOIN q ON p.k = q.k
""")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "queue-seed")


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(word, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (CAST(xor(CAST(h AS BIGINT), CAST(c AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296)"


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{vectors.WORD}')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT word, count(*) AS df, CAST({_FNV} AS BIGINT) AS h FROM tf GROUP BY word), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, h % 64 AS slot, sum((1 + ln(tf)) * ln(CAST(1 + n AS DOUBLE) / (1 + df)) * CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS w FROM tf JOIN df USING (word), n GROUP BY doc_id, h % 64),
m AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM w)
SELECT doc_id, slot, round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 6) + 0.0 AS weight FROM m
""")
def tfidf_hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.hashed_tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", 64)
    return found.select("doc_id", "slot", (F.round("weight", 6) + 0.0).alias("weight"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM s)
SELECT id, neighbour, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 15
""")
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mutual(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 15).withColumn("similarity", F.round("similarity", 6))


@query("SELECT min(vec_id) AS first_id, count(*) AS copies FROM embeddings GROUP BY embedding")
def identical_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.identical(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("""
WITH f AS (SELECT DISTINCT doc_id, source AS cluster, unnest(regexp_extract_all(lower(text), '[a-z]{4,12}')) AS facet FROM documents), n AS (SELECT source AS cluster, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT count(*) AS a FROM documents),
i AS (SELECT cluster, facet, count(*) AS k FROM f GROUP BY ALL), b AS (SELECT facet, count(*) AS b FROM f GROUP BY ALL),
s AS (SELECT i.cluster, i.facet, i.k AS members, round((CAST(i.k AS DOUBLE) / n.n) * ln((CAST(i.k AS DOUBLE) / n.n) / (CAST(b.b AS DOUBLE) / a.a) + 1e-9), 6) AS score FROM i JOIN n USING (cluster) JOIN b USING (facet), a WHERE i.k >= n.n * 0.25),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, facet) AS rank FROM s)
SELECT * FROM r WHERE rank <= 3
""")
def facet_lift_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "cluster")
    facets = docs.select("doc_id", "cluster", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,12}"), F.lit(0)))).alias("facet"))
    return enrichment.facet_lift(facets, "doc_id", "cluster", "facet", docs.select("doc_id", "cluster"))


@query("""
WITH RECURSIVE b AS (SELECT min(c_acctbal) AS x0, max(c_acctbal) AS x1, CAST(min(c_nationkey) AS DOUBLE) AS y0, CAST(max(c_nationkey) AS DOUBLE) AS y1 FROM customer),
p AS (SELECT c_custkey, CAST(least(31, floor((c_nationkey - y0) / greatest(y1 - y0, 1e-6) * 32)) * 32 + least(31, floor((c_acctbal - x0) / greatest(x1 - x0, 1e-6) * 32)) AS BIGINT) AS cell FROM customer, b),
d AS (SELECT cell FROM p GROUP BY cell HAVING count(*) >= 4),
r AS (SELECT cell, cell AS reached FROM d UNION SELECT r.cell, d.cell FROM r JOIN d ON abs(r.reached - d.cell) = 32 OR (abs(r.reached - d.cell) = 1 AND r.reached // 32 = d.cell // 32)),
l AS (SELECT cell, min(reached) AS cluster FROM r GROUP BY cell)
SELECT p.c_custkey, p.cell, coalesce(l.cluster, -1) AS cluster FROM p LEFT JOIN l USING (cell)
""")
def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return vectors.density_clusters(points, "c_custkey", "x", "y", grid=32)


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def knn_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of all vectors' 15 nearest; of the vectors whose id 100 divides, whether 0.9 of the exact ones are among them."""
    v = table(spark, sf_dir, "embeddings")
    exact = vectors.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 15)
    found = layout.recall(layout.knn_graph(v, "vec_id", "embedding", 15).where("id % 100 = 0"), exact, 1e-6)
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))


_BOX = """
b AS (SELECT c_mktsegment AS family, min(c_acctbal) AS x0, max(c_acctbal) AS x1, CAST(min(c_custkey) AS DOUBLE) AS y0, CAST(max(c_custkey) AS DOUBLE) AS y1 FROM customer GROUP BY 1),
p AS (SELECT c_custkey, family, CAST(least(31, floor((c_acctbal - x0) / greatest(x1 - x0, 1e-6) * 32)) AS BIGINT) AS px, CAST(least(31, floor((c_custkey - y0) / greatest(y1 - y0, 1e-6) * 32)) AS BIGINT) AS py FROM customer JOIN b ON family = c_mktsegment),
g AS (SELECT family, x.px, y.py FROM b, range(32) x(px), range(32) y(py)),
m0 AS (SELECT g.*, CAST(count(p.family) AS DOUBLE) AS d FROM g LEFT JOIN p USING (family, px, py) GROUP BY g.family, g.px, g.py),
m1 AS (SELECT a.family, a.px, a.py, avg(b.d) AS d FROM m0 a JOIN m0 b ON a.family = b.family AND abs(a.px - b.px) <= 3 AND abs(a.py - b.py) <= 3 GROUP BY ALL),
m2 AS (SELECT a.family, a.px, a.py, avg(b.d) AS d FROM m1 a JOIN m1 b ON a.family = b.family AND abs(a.px - b.px) <= 3 AND abs(a.py - b.py) <= 3 GROUP BY ALL)"""


@query(f"""
WITH RECURSIVE {_BOX},
t AS (SELECT avg(d) AS t FROM m0), h AS (SELECT family, px, py, py * 32 + px AS c FROM m2, t WHERE round(d, 9) >= round(t.t, 4)),
r AS (SELECT family, c, c AS reached FROM h UNION SELECT r.family, r.c, h.c FROM r JOIN h ON h.family = r.family AND (abs(r.reached - h.c) = 32 OR (abs(r.reached - h.c) = 1 AND r.reached // 32 = h.c // 32))),
l AS (SELECT family, c, min(reached) AS cluster FROM r GROUP BY family, c)
SELECT m2.family, m2.px, m2.py, round(m2.d, 6) AS density, l.cluster FROM m2 LEFT JOIN l ON l.family = m2.family AND l.c = m2.py * 32 + m2.px
""")
def density_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance and key, a raster for each segment, blurred twice; clusters of the cells above the mean."""
    points = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    density = layout.density_map(points, "family", "x", "y", grid=32)
    families = points.select("family").distinct().count()
    found = layout.clusters(density, "family", round(points.count() / max(1, families * 32 * 32), 4))
    named = found.select("family", "px", "py", (F.col("top_y") * 32 + F.col("top_x")).alias("cluster"))
    return density.join(named, ["family", "px", "py"], "left").select("family", "px", "py", F.round("density", 6).alias("density"), "cluster")


@query()
def lcs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("actions"))
    pairs = ops.select((F.col("user_id") - 1).alias("k"), F.col("actions").alias("right")).join(ops.select(F.col("user_id").alias("k"), F.col("actions").alias("left")), "k")
    return vectors.align(pairs, "left", "right").select("k", "common", "similarity", "divergent")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (
  SELECT conv_id, turn, size, n, 0 AS chunk, size AS used FROM t WHERE n = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.size, t.n, CASE WHEN used > 0 AND used + t.size > 2000 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + t.size > 2000 THEN t.size ELSE used + t.size END
  FROM t JOIN r ON t.conv_id = r.conv_id AND t.n = r.n + 1
)
SELECT conv_id, turn, size, CAST(chunk AS BIGINT) AS chunk FROM r
""")
def ledger_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return sampling.budget_chunks(rows, "conv_id", ["turn"], "size", 2000)


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 ELSE 1 END AS tier, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, turn) AS n FROM conversations),
r AS (
  SELECT conv_id, turn, tier, size, n, size <= 1500 AS selected, CASE WHEN size <= 1500 THEN 1500 - size ELSE 1500 END AS rest FROM t WHERE n = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.tier, t.size, t.n, t.size <= rest, CASE WHEN t.size <= rest THEN rest - t.size ELSE rest END FROM t JOIN r ON t.conv_id = r.conv_id AND t.n = r.n + 1
)
SELECT conv_id, turn, tier, size, selected FROM r
""")
def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("tier"), F.length("text").cast("long").alias("size"))
    return sampling.select_evidence(rows, "conv_id", "tier", ["turn"], "size", 1500)
