"""Cluster by arm: observed and expected counts, adjusted residuals, totals, facets by lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.sources.scratch import written


def cluster_arm(units: DataFrame, stratified: bool, where: str = "true", size: int | None = None) -> DataFrame:
    """units: family, cluster_id, condition, attempt_id, stratum. A row for each cluster, arm and stratum of the arm.

    Expected: the cluster's units in the stratum times the arm's share of the family's units there. z is the
    adjusted standardized residual; 0 where its variance is 0. Units outside clusters (negative ids) count in
    families and arms only.

    Units are made once and sorted by attempt, where an attempt's first unit in its arm and in a cluster is marked; all
    counts are sums over what that leaves. With ``size``, about how many units there are, a task sorts a million or so.
    """
    pop = units.where(F.expr(where)).withColumn("stratum", F.coalesce("stratum", F.lit("")) if stratified else F.lit(""))
    if size is not None:
        pop = pop.repartition(-(-size // 1_000_000) or 1, "attempt_id")
    inner = W.partitionBy("attempt_id", "condition").orderBy("cluster_id")
    known, first = F.col("attempt_id").isNotNull(), F.row_number().over(inner) == 1
    marked = pop.withColumns({"__arm": known & first, "__cluster": known & (first | ~F.lag("cluster_id").over(inner).eqNullSafe(F.col("cluster_id")))})
    cells = written(marked.groupBy("family", "stratum", "condition", "cluster_id").agg(F.count("*").alias("n"), F.count_if("__arm").alias("k_arm"), F.count_if("__cluster").alias("k")), "cells")
    inside = cells.where("cluster_id IS NOT NULL AND (typeof(cluster_id) = 'string' OR try_cast(cluster_id AS BIGINT) >= 0)")
    f = cells.groupBy("family", "stratum").agg(F.sum("n").alias("n_f"))
    fa = cells.groupBy("family", "stratum", "condition").agg(F.sum("n").alias("n_fa"))
    cl = inside.groupBy("family", "cluster_id").agg(F.sum("n").alias("n_total"))
    cs = inside.groupBy("cluster_id", "stratum").agg(F.sum("n").alias("n_c"))
    ca = inside.groupBy("cluster_id", "condition").agg(F.sum("n").alias("o"), F.sum("k").alias("k"))
    arm = cells.groupBy("condition").agg(F.sum("k_arm").alias("k_arm"))
    rows = cl.join(fa, "family").join(f, ["family", "stratum"]).join(arm, "condition", "left").join(cs, ["cluster_id", "stratum"], "left").join(ca, ["cluster_id", "condition"], "left")
    rows = rows.na.fill(0, ["n_c", "o", "k"])
    e = F.col("n_c") * F.col("n_fa") / F.col("n_f")
    rows = rows.withColumn("expected", e)
    variance = F.col("expected") * (1 - F.col("n_c") / F.col("n_f")) * (1 - F.col("n_fa") / F.col("n_f"))
    z = F.when(variance > 0, (F.col("o") - F.col("expected")) / F.sqrt(variance)).otherwise(F.lit(0.0))
    return rows.withColumn("z", z).withColumn("ratio", F.coalesce(F.try_divide("o", "expected"), F.lit(0.0)))


def arm_totals(df: DataFrame, attempt: str, arm: str, category: str) -> DataFrame:
    """Per arm and category: the sum, mean, least and most rows of an attempt; attempts without any count as 0."""
    per = df.groupBy(arm, attempt, category).agg(F.count("*").alias("n"))
    attempts = df.groupBy(arm).agg(F.count_distinct(attempt).alias("attempts"))
    found = per.groupBy(arm, category).agg(F.sum("n").alias("total"), F.min("n").alias("__least"), F.max("n").alias("most"), F.count("*").alias("__with"))
    rows = found.join(attempts, arm)
    least = F.when(F.col("__with") < F.col("attempts"), 0).otherwise(F.col("__least"))
    return rows.select(arm, category, "attempts", "total", (F.col("total") / F.col("attempts")).alias("mean"), least.alias("least"), "most")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).withColumnRenamed("__k", "rank")


def facet_lift(facets: DataFrame, id: str, cluster: str, facet: str, members: DataFrame, share: float = 0.25, k: int = 3) -> DataFrame:
    """facets: distinct (id, cluster, facet); members: (id, cluster). Per cluster, the facets that a quarter of its
    members have, by share times the log of the lift over all members; the first k."""
    size = members.groupBy(cluster).agg(F.count("*").alias("__n"))
    total = members.agg(F.count("*").alias("__all"))
    inside = facets.groupBy(cluster, facet).agg(F.count("*").alias("__k"))
    overall = facets.groupBy(facet).agg(F.count("*").alias("__b"))
    rows = inside.join(size, cluster).where(F.col("__k") >= F.col("__n") * share).join(overall, facet).crossJoin(F.broadcast(total))  # one row
    p = F.col("__k") / F.col("__n")
    rows = rows.withColumn("score", p * F.log(p / (F.col("__b") / F.col("__all")) + 1e-9))
    return top_k(rows.select(cluster, facet, F.col("__k").alias("members"), F.round("score", 6).alias("score")), [cluster], [F.desc("score"), facet], k)
