"""Reviews against judgments: latest decisions, outcomes, agreement and its roll-up."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.aggregation import grouped
from tracemill.operators.scan import scan


def latest_reviews(decisions: DataFrame) -> DataFrame:
    """decisions: assertion, reviewer, kind (review, adjudication), state, idx. The last review of each reviewer."""
    last = W.partitionBy("assertion", "reviewer").orderBy(F.desc("idx"))
    return decisions.where("kind = 'review'").withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def review_outcomes(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates: assertion, abstained. Adds outcome and disputed.

    An adjudication decides if it comes after the last review. Otherwise reviewers must agree, none of them
    disputing or lacking evidence; no review leaves the assertion unreviewed; an abstaining judge has no outcome.
    """
    own = decisions.groupBy("assertion").agg(
        F.max(F.when(F.col("kind") == "review", F.col("idx"))).alias("__review"),
        F.max(F.when(F.col("kind") == "adjudication", F.struct("idx", "state"))).alias("__adj"),
    )
    state = F.col("state")
    reviews = latest_reviews(decisions).groupBy("assertion").agg(
        F.count_if(state.isin("disputed", "insufficient-evidence")).alias("__open"),
        F.count_if(state == "disputed").alias("__disputes"),
        F.collect_set(state).alias("__states"),
        F.collect_set(F.when(state != "insufficient-evidence", state)).alias("__comparable"),
    )
    rows = candidates.join(own, "assertion", "left").join(reviews, "assertion", "left")
    adjudged = F.when(F.col("__adj.idx") > F.coalesce("__review", F.lit(-1)), F.col("__adj.state"))
    single = F.when(F.size("__states") == 1, F.element_at("__states", 1))
    outcome = (
        F.when(F.col("abstained"), "judge-abstained")
        .when(adjudged.isin("confirmed", "rejected"), adjudged)
        .when(adjudged.isNotNull(), "unresolved")
        .when(F.col("__review").isNull(), "unreviewed")
        .when((F.col("__open") > 0) | single.isNull(), "unresolved")
        .otherwise(single)
    )
    disputed = F.when(adjudged.isNotNull(), adjudged == "disputed").otherwise((F.col("__disputes") > 0) | (F.size("__comparable") > 1))
    rows = rows.withColumn("outcome", outcome).withColumn("disputed", (F.col("outcome") == "unresolved") & F.coalesce(disputed, F.lit(False)))
    return rows.select(*candidates.columns, "outcome", "disputed")


def human_pairs(decisions: DataFrame) -> DataFrame:
    """Per assertion, pairs of reviewers with comparable decisions, and how many of them agree, from counts of states."""
    each = latest_reviews(decisions).where("state <> 'insufficient-evidence'").groupBy("assertion", "state").agg(F.count("*").alias("n"))
    same = F.col("n") * (F.col("n") - 1) / 2
    per = each.groupBy("assertion").agg(F.sum("n").alias("__n"), F.sum(same).alias("agreements"))
    return per.select("assertion", (F.col("__n") * (F.col("__n") - 1) / 2).cast("long").alias("pairs"), F.col("agreements").cast("long").alias("agreements"))


def agreement(df: DataFrame, category: str, judge: str, human: str) -> DataFrame:
    """Per category, and in all (a null category): comparable rows, agreements and their rate."""
    comparable = F.col(judge).isNotNull() & F.col(human).isNotNull()
    n, same = F.count_if(comparable), F.count_if(comparable & (F.col(judge) == F.col(human)))
    per = grouped(df, [category]).rollup(category).agg(F.count("*").alias("selected"), n.alias("denominator"), same.alias("agreements"))
    return per.withColumn("disagreements", F.col("denominator") - F.col("agreements")).withColumn("rate", F.try_divide("agreements", "denominator")).withColumn("status", F.when(F.col("denominator") > 0, "available").otherwise("unavailable"))


def broken_links() -> Callable[[str | None, str | None], bool]:
    """A fold that tells whether a link's claim differs from the digest of all digests before it."""
    running = hashlib.sha256()

    def check(digest: str | None, claimed: str | None) -> bool:
        broken = running.hexdigest() != claimed
        running.update((digest or "").encode())
        return broken

    return check


def history_breaks(decisions: DataFrame) -> DataFrame:
    """decisions: log, idx, digest, previous_history (the digest of all digests before). Rows whose link doesn't hold.

    Each log is read once in order with one running hash, so its cost is linear in its length and a task keeps the hash only.
    """
    rows = scan(decisions.select("log", "idx", "digest", "previous_history"), ["log"], ["idx"], ["digest", "previous_history"], broken_links, "broken", "boolean")
    return rows.where("broken").select(F.col("log").cast("string").alias("log"), F.col("idx").cast("long").alias("idx"))


def behavior_matrix(df: DataFrame, category: str, arm: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """A row for each category and arm, a column for each outcome."""
    return df.groupBy(category, arm).pivot(outcome, outcomes).count().na.fill(0, outcomes)
