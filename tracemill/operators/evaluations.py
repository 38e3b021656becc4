"""Judgments and decisions checked: answers, ratings, citations, claims; breaches are rows, none means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.filters import accepted_by_policy
from tracemill.operators.sequences import first_per_key

TOLERANCE = 0.03
DISPOSITIONS = ("assessed", "abstained")
ASSESSMENTS = ("constructive", "adverse", "mixed", "context-dependent")


def decision_breaches(answers: DataFrame) -> DataFrame:
    """answers: question, type (choice, score, noul), options (array), choice, value, probabilities (map), confidence."""
    p = F.map_values("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    graded = F.col("type").isin("choice", "score")
    problems = [
        F.when((F.col("type") == "noul") & ~F.coalesce(F.col("value").between(0, 1), F.lit(False)), "invalid-noul"),
        F.when(graded & ~F.coalesce(F.array_sort(F.map_keys("probabilities")) == F.array_sort("options"), F.lit(False)), "probabilities-differ-from-options"),
        F.when(graded & F.exists(F.coalesce(p, F.array().cast("array<double>")), lambda x: (x < 0) | (x > 1)), "invalid-probability"),
        F.when(graded & ~F.coalesce(F.abs(total - 1) <= TOLERANCE, F.lit(False)), "probabilities-do-not-sum-to-1"),
        F.when(graded & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "invalid-confidence"),
        F.when((F.col("type") == "choice") & ~F.coalesce(F.array_contains("options", F.col("choice")), F.lit(False)), "undeclared-option"),
        F.when((F.col("type") == "score") & ~F.coalesce(F.col("value").between(0, F.size("options") - 1), F.lit(False)), "score-out-of-range"),
    ]
    return answers.select("question", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def final_ratings(answers: DataFrame) -> DataFrame:
    """answers: occurrence, dimension, source (rule, model, fallback), kind, confidence, probability, value.

    A rule decides first, then a model's answer that the policy accepts, then the fallback; a model's answer
    that isn't accepted is deferred, and counts only where there is nothing better.
    """
    accepted = accepted_by_policy(F.col("kind"), F.col("confidence"), F.col("probability"))
    rank = F.when(F.col("source") == "rule", 0).when((F.col("source") == "model") & F.coalesce(accepted, F.lit(False)), 1).when(F.col("source") == "fallback", 2).otherwise(3)
    rows = answers.withColumn("__precedence", rank)
    best = first_per_key(rows, ["occurrence", "dimension"], [F.col("__precedence"), F.col("source")])
    return best.withColumn("status", F.when(F.col("__precedence") == 3, "deferred").otherwise("decided")).drop("__precedence")


def no_response(operations_after: Column, failures: Column) -> Column:
    """Rule: a failure that nothing followed."""
    return F.when((failures > 0) & (operations_after == 0), "no-response").when(failures > 0, "responded")


# fixed value: an output that says nothing, or a harness's mark of that
EMPTY_OUTPUT = r"(?i)^\s*(?:\(?\s*(?:no output|bash completed with no output)\s*\)?)?\s*$"


def silent_success(calls: Column) -> Column:
    """Rule: one call (result, output) that passed and said nothing; what an output would tell is then known."""
    first = F.try_element_at(calls, F.lit(1))
    said = F.coalesce(first["output"], F.lit(""))
    return F.coalesce((F.size(calls) == 1) & (first["result"] == "passed") & said.rlike(EMPTY_OUTPUT), F.lit(False))


def tagged_units(units: DataFrame, links: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """units: attempt_id, unit_id, unit_kind, episode_id; links: unit_id, event_id; citations: attempt_id, event_id,
    assertion_id, label; sources: attempt_id, event_id, extractor_id. Adds cited_assertions with their labels, cited and
    observation_extractors: what cites a unit's events and what draws on them; an episode has those of its units.

    Tags are joined to events and gathered for units, so an event that many cite is a row for each of them, not a list.
    """
    kind = F.col("unit_kind") == "episode"
    inside = units.where(~kind & F.col("episode_id").isNotNull()).select("attempt_id", F.col("unit_id").alias("part"), F.col("episode_id").alias("unit_id"))
    parts = units.where(~kind).select("attempt_id", F.col("unit_id").alias("part"), "unit_id").unionByName(inside.join(units.where(kind).select("unit_id"), "unit_id", "left_semi").select("attempt_id", "part", "unit_id"))
    events = parts.join(links.withColumnRenamed("unit_id", "part"), "part").select("attempt_id", "unit_id", "event_id").distinct()
    cited = events.join(citations, ["attempt_id", "event_id"]).groupBy("unit_id", "assertion_id").agg(F.min("label").alias("label"))
    cited = cited.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("assertion_id", "label"))).alias("c"))
    drawn = events.join(sources, ["attempt_id", "event_id"]).groupBy("unit_id").agg(F.array_sort(F.collect_set("extractor_id")).alias("x"))
    none = F.array().cast("array<string>")
    field = lambda name: F.coalesce(F.transform("c", lambda e: e[name].cast("string")), none)
    rows = units.join(cited, "unit_id", "left").join(drawn, "unit_id", "left")
    return rows.select(*units.columns, field("assertion_id").alias("cited_assertions"), field("label").alias("cited_assessments"), F.col("c").isNotNull().alias("cited"), F.coalesce("x", none).alias("observation_extractors"))


def resolved_citations(citations: DataFrame, events: DataFrame) -> DataFrame:
    """Citations with whether their event exists."""
    known = events.select("attempt_id", F.col("id").alias("event_id"), F.lit(True).alias("__known"))
    return citations.join(known, ["attempt_id", "event_id"], "left").withColumn("resolved", F.col("__known").isNotNull()).drop("__known")


def assertion_breaches(assertions: DataFrame, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """assertions: assertion_id, disposition, assessment, digest, rebuilt_digest; citations: assertion_id, event_id,
    resolved; claims: assertion_id, claim_id, event_ids."""
    a = F.col("assessment")
    own = [
        F.when(~F.col("disposition").isin(*DISPOSITIONS), "unknown-disposition"),
        F.when((F.col("disposition") == "assessed") & ~F.coalesce(a.isin(*ASSESSMENTS), F.lit(False)), "unknown-assessment"),
        F.when((F.col("disposition") == "abstained") & a.isNotNull(), "abstention-with-assessment"),
        F.when(~F.col("digest").eqNullSafe(F.col("rebuilt_digest")), "stale-digest"),
    ]
    one = assertions.select("assertion_id", F.explode(F.array_compact(F.array(*own))).alias("problem"))
    two = citations.where("NOT resolved").select("assertion_id", F.lit("citation-unresolved").alias("problem"))
    cited = citations.groupBy("assertion_id").agg(F.collect_set("event_id").alias("__cited"))
    loose = F.size(F.array_except("event_ids", F.coalesce("__cited", F.array().cast("array<string>")))) > 0
    three = claims.join(cited, "assertion_id", "left").where(loose).select("assertion_id", F.lit("claim-cites-beyond-assertion").alias("problem"))
    return one.unionByName(two).unionByName(three).distinct()


def coverage(ratings: DataFrame, asked: DataFrame) -> DataFrame:
    """Per dimension: questions asked, answered, decided and deferred."""
    rows = asked.join(ratings.select("occurrence", "dimension", "status"), ["occurrence", "dimension"], "left")
    return rows.groupBy("dimension").agg(F.count("*").alias("asked"), F.count("status").alias("answered"), F.count_if(F.col("status") == "decided").alias("decided"), F.count_if(F.col("status") == "deferred").alias("deferred"))


def link_citations(cited: DataFrame, units: DataFrame, tolerance_ms: int = 5000) -> DataFrame:
    """cited: citation, event, artifact, line, kind, t; units: unit, event, artifact, line, kind, t (t in milliseconds).

    A citation links to the unit of its own event; or else to the last unit before it in the same artifact; or
    else to the nearest of its kind within the tolerance. ``how`` says which.
    """
    from tracemill.operators.sequences import asof_backward, nearest_within

    by_event = units.where("event IS NOT NULL").groupBy("event").agg(F.min("unit").alias("__event_unit"))
    rows = cited.join(by_event, "event", "left")
    by_line = asof_backward(rows, units.select("artifact", "line", "unit"), ["artifact"], "line", "line", "__line_", strict=False)
    near = nearest_within(by_line.select("citation", "kind", "t"), units.where("t IS NOT NULL").select("kind", "t", "unit"), ["kind"], "t", "t", tolerance_ms, "__near_")
    rows = by_line.join(near.select("citation", F.col("__near_unit")), "citation", "left")
    how = F.when(F.col("__event_unit").isNotNull(), "event").when(F.col("__line_unit").isNotNull(), "order").when(F.col("__near_unit").isNotNull(), "time")
    return rows.select("citation", F.coalesce("__event_unit", "__line_unit", "__near_unit").alias("unit"), how.alias("how"))
