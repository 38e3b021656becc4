"""Occurrences, structural observations and behavior units of normalized events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions import commands
from tracemill.functions.availability import capability_gate
from tracemill.operators import sequences as seq
from tracemill.operators.aggregation import resource_total
from tracemill.operators.filters import compaction, explicit_failure
from tracemill.sources.scratch import written

TYPES = ("failure-response", "validation-run", "source-change", "repeated-operation", "compaction", "delegation")
HEURISTIC = ("validation-run", "source-change", "compaction")
#: Tools that change sources, and the checks that count as validation.
EDIT_TOOLS = commands.TOOL_KINDS["edit"].split()
VALIDATIONS = ("test", "typecheck", "lint", "build")
TOKENS = {"input-tokens": "inputTokens", "output-tokens": "outputTokens", "cache-read-tokens": "cacheReadInputTokens", "cache-creation-tokens": "cacheCreationInputTokens", "thinking-tokens": "thinkingTokens", "cost-usd": "totalCostUsd"}


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def timed(events: DataFrame) -> DataFrame:
    """Events with ``at``, their place in an attempt: time, then order value, then id; unknown ones last."""
    at = F.struct(F.coalesce(F.unix_millis(F.try_to_timestamp("event_time")), F.lit((1 << 63) - 1)).alias("t"), F.coalesce("order_value", F.lit((1 << 63) - 1)).alias("n"), F.col("id").alias("i"))
    return events.withColumn("at", at)


def held(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and their operations, each made once: what follows goes over them several times, and filters on attributes
    would otherwise be pushed below the parsing of records, which is then done anew for each attribute."""
    rows = written(events, "events")
    return rows, written(operations(rows), "operations")


def operations(events: DataFrame) -> DataFrame:
    """Logical operations: the tool events of one call, scoped by session. Events without a call id are none."""
    rows = timed(events.where("family = 'tool'")).withColumn("operation", attribute("callId")).where("operation IS NOT NULL")
    status = attribute("status")
    passed = (attribute("isError") == "false") | (status == "completed") | (attribute("exitCode") == "0") | (attribute("hook") == "PostToolUse")
    session = F.coalesce(attribute("sessionId"), F.lit(""))
    return rows.groupBy("attempt_id", session.alias("session"), F.coalesce("order_domain", F.lit("")).alias("domain"), "operation").agg(
        F.min("at").alias("started"),
        F.max("at").alias("ended"),
        F.max(attribute("toolName")).alias("tool"),
        F.max(attribute("inputDigest")).alias("input_digest"),
        F.max(attribute("command")).alias("command"),
        F.bool_or(F.coalesce(explicit_failure(F.col("attributes")), F.lit(False))).alias("failed"),
        F.bool_or(F.coalesce(passed, F.lit(False))).alias("passed"),
        F.bool_or(F.coalesce(attribute("mutation") == "true", F.lit(False))).alias("mutation"),
        F.min_by("id", "at").alias("first_event"),
        F.max_by("id", "at").alias("last_event"),
        F.count("*").alias("records"),
    )


def _occurrence(df: DataFrame, kind: str, event: str, **attributes: Column) -> DataFrame:
    fields = F.map_filter(F.create_map(*(x for k, v in attributes.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())
    return df.select("attempt_id", F.lit(kind).alias("type"), F.col(event).alias("first_event"), F.lit(kind in HEURISTIC).alias("heuristic"), fields.alias("attributes"))


def occurrences(events: DataFrame, ops: DataFrame) -> DataFrame:
    """attempt_id, type, first_event, heuristic, attributes; and occurrence_id, unique within an attempt."""
    f = commands.udfs(events.sparkSession)
    ops = ops.withColumn("checks", f["check_kinds"]("command")).withColumn("writes", f["shell_writes"]("command"))
    chains = seq.failure_chains(ops, ["attempt_id", "session", "domain"], "started", "tool", "failed", "first_event")
    one = _occurrence(chains, "failure-response", "first_failure", toolName=F.col("tool"), failures=F.col("failures"), lastFailure=F.col("last_failure"), response=F.col("response"), nextOutcome=F.col("next_outcome"))
    result = F.when(F.col("failed"), "failed").when(F.col("passed"), "passed").otherwise("unknown")
    checked = ops.where(F.arrays_overlap("checks", F.array(*map(F.lit, VALIDATIONS))))
    two = _occurrence(checked, "validation-run", "first_event", toolName=F.col("tool"), checkKinds=F.array_join("checks", ","), result=result)
    inferred = F.col("passed") & ~F.col("failed")
    how = F.when(F.col("mutation"), "explicit-mutation").when(inferred & F.lower("tool").isin(*EDIT_TOOLS), "edit-tool").when(inferred & (F.size("writes") > 0), "shell-write")
    changed = ops.withColumn("__how", how).where("__how IS NOT NULL")
    three = _occurrence(changed, "source-change", "first_event", toolName=F.col("tool"), detectedBy=F.col("__how"), paths=F.when(F.size("writes") > 0, F.array_join("writes", ",")))
    again = seq.repeats(ops, ["attempt_id"], ["started", "first_event"], ["tool", "input_digest"])
    four = _occurrence(again, "repeated-operation", "first_event", toolName=F.col("tool"), firstEvent=F.col("first_id"))
    is_compaction = compaction(F.col("family"), F.col("attributes"))
    kind = F.when(is_compaction, F.concat_ws("/", "native_type", F.coalesce(attribute("hook"), F.col("subtype"), F.lit(""))))
    breaks = F.col("family").isin("tool") | ((F.col("family") == "message") & (F.col("actor_kind") != "harness"))
    place = timed(events).select("attempt_id", "id", F.col("at.t").alias("t"), F.col("at.n").alias("n"), kind.alias("kind"), breaks.alias("breaks"))
    bounds = seq.compaction_boundaries(place, "attempt_id", ["t", "n", "id"]).where("boundary IS NOT NULL")
    bounds = bounds.groupBy("attempt_id", "boundary").agg(F.min_by("id", F.struct("t", "n", "id")).alias("first_event"), F.count("*").alias("records"))
    five = _occurrence(bounds, "compaction", "first_event", records=F.col("records"))
    task = F.coalesce(attribute("taskId"), attribute("agentId"), F.when(F.col("scope_kind") == "operation", F.col("scope_id")), F.concat(F.lit("event:"), F.col("id")))
    delegated = timed(events.where("family = 'delegation'")).groupBy("attempt_id", task.alias("task")).agg(F.min_by("id", "at").alias("first_event"), F.count("*").alias("records"))
    six = _occurrence(delegated, "delegation", "first_event", taskId=F.when(~F.col("task").startswith("event:"), F.col("task")), records=F.col("records"))
    out = one.unionByName(two).unionByName(three).unionByName(four).unionByName(five).unionByName(six)
    return out.withColumn("occurrence_id", F.concat_ws("/", "attempt_id", F.lit("occ"), "type", "first_event"))


def coverage(attempts: DataFrame, found: DataFrame, unavailable: dict[str, str]) -> DataFrame:
    """Each attempt and type with its count, or the reason why there can be none (never 0 in its place)."""
    spark = attempts.sparkSession
    types = spark.createDataFrame([(t, unavailable.get(t)) for t in TYPES], "type string, reason string")
    counts = found.groupBy("attempt_id", "type").agg(F.count("*").alias("n"))
    rows = attempts.select("attempt_id").distinct().crossJoin(F.broadcast(types)).join(counts, ["attempt_id", "type"], "left")  # six types
    return rows.select("attempt_id", "type", F.when(F.col("reason").isNull(), "available").otherwise("unavailable").alias("status"), F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).alias("count"), "reason")


def observations(events: DataFrame, ops: DataFrame, capability: Column) -> DataFrame:
    """Long form: attempt_id, extractor_id, status, num, unit, reason. capability: of tool evidence, by attempt."""
    tools = events.where("family = 'tool'")
    native = tools.groupBy("attempt_id").agg(F.count("*").alias("tool-native-record-count"), F.count_if(attribute("callId").isNull()).alias("tool-unidentified-count"))
    logical = ops.groupBy("attempt_id").agg(F.count("*").alias("tool-operation-count"), F.count_if("failed").alias("tool-error-count"))
    repeated = seq.repeats(ops, ["attempt_id"], ["started", "first_event"], ["tool", "input_digest"]).groupBy("attempt_id").agg(F.count("*").alias("tool-repeated-count"))
    answers = seq.failure_responses(ops, ["attempt_id", "domain"], "started", "tool", "failed").groupBy("attempt_id").agg(F.count_if(F.col("response") == "same").alias("failure-to-same-tool"), F.count_if(F.col("response") == "alternate").alias("failure-to-alternate-tool"))
    every = events.groupBy("attempt_id").agg(F.count_if(compaction(F.col("family"), F.col("attributes"))).alias("compaction-count"), ((F.max(F.unix_millis(F.try_to_timestamp("event_time"))) - F.min(F.unix_millis(F.try_to_timestamp("event_time"))))).alias("latency-ms"))
    wide = every
    for part in (native, logical, repeated, answers):
        wide = wide.join(part, "attempt_id", "left")
    gated = ["tool-native-record-count", "tool-unidentified-count", "tool-operation-count", "tool-error-count", "tool-repeated-count", "failure-to-same-tool", "failure-to-alternate-tool"]
    plain = [F.struct(F.lit(c).alias("extractor_id"), capability_gate(F.coalesce(F.col(f"`{c}`"), F.lit(0)), capability).alias("v")) for c in gated]
    known = lambda c, unit: F.struct(F.when(c.isNotNull(), "known").otherwise("unavailable").alias("status"), c.cast("double").alias("value"), F.lit(unit).alias("unit"), F.when(c.isNull(), "No event has the evidence.").alias("reason"))
    plain += [F.struct(F.lit(c).alias("extractor_id"), known(F.col(f"`{c}`"), u).alias("v")) for c, u in (("compaction-count", "count"), ("latency-ms", "millisecond"))]
    long = wide.select("attempt_id", F.explode(F.array(*plain)).alias("x")).select("attempt_id", "x.extractor_id", "x.v.status", F.col("x.v.value").alias("num"), "x.v.unit", "x.v.reason")
    semantics = F.element_at(F.create_map(*(F.lit(x) for p in {"cumulative-final": "final", "cumulative-snapshot": "snapshot", "increment": "increment"}.items() for x in p)), attribute("resourceSemantics"))
    amounts = timed(events).where(attribute("resourceSemantics").isNotNull()).select("attempt_id", "at", semantics.alias("semantics"), F.explode(F.create_map(*(x for k, a in TOKENS.items() for x in (F.lit(k), attribute(a).try_cast("double"))))).alias("extractor_id", "amount")).where("amount IS NOT NULL")
    totals = resource_total(amounts, ["attempt_id", "extractor_id"], "at")
    unit = F.when(F.col("extractor_id") == "cost-usd", "usd").otherwise("token")
    reason = F.when(F.col("status") == "unavailable", F.concat(F.lit("Resource evidence: "), F.col("basis")))
    return long.unionByName(totals.select("attempt_id", "extractor_id", "status", F.col("total").alias("num"), F.when(F.col("status") == "known", unit).alias("unit"), reason.alias("reason")))


def units(events: DataFrame, ops: DataFrame, found: DataFrame) -> DataFrame:
    """Behavior units of an attempt in order: messages, tools, compactions and delegations, each in its episode.

    A user's message opens an episode; what follows belongs to it until the next one. A time that is unknown
    is the last known one before it.
    """
    at = timed(events)
    role = F.when(F.col("actor_kind").isin("model", "agent"), "assistant").when(F.col("actor_kind") == "user", "user").otherwise("harness")
    messages = at.where("family = 'message' AND phase <> 'during'").select("attempt_id", "at", F.lit("message").alias("unit_kind"), role.alias("role"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("command"), F.lit("ok").alias("status"), F.col("id").alias("first_event"))
    status = F.when(F.col("failed"), "failed").when(F.col("passed"), "ok").otherwise("unknown")
    tools = ops.select("attempt_id", F.col("started").alias("at"), F.lit("tool").alias("unit_kind"), F.lit(None).cast("string").alias("role"), F.col("tool").alias("tool_name"), "command", status.alias("status"), "first_event")
    places = at.select("attempt_id", F.col("id").alias("first_event"), "at")
    marks = found.where("type IN ('compaction', 'delegation')").join(places, ["attempt_id", "first_event"]).select("attempt_id", "at", F.col("type").alias("unit_kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("command"), F.lit("ok").alias("status"), "first_event")
    rows = messages.unionByName(tools).unionByName(marks)
    rows = seq.episodes(rows, ["attempt_id"], ["at"], (F.col("unit_kind") == "message") & (F.col("role") == "user"))
    known = F.when(F.col("at.t") < (1 << 63) - 1, F.col("at.t"))
    rows = seq.carry_forward(rows, ["attempt_id"], ["at"], known, "t_ms")
    f = commands.udfs(events.sparkSession)
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("attempt_id").orderBy("at")) - 1).withColumn("tool_kind", F.when(F.col("unit_kind") == "tool", commands.tool_kind(F.col("tool_name"))))
    rows = rows.withColumn("command_head", F.when(F.col("command").isNotNull(), f["command_head"]("command"))).withColumn("check_kind", F.when(F.col("command").isNotNull(), f["primary_check"]("command")))
    action = F.when(F.col("unit_kind") != "tool", F.col("unit_kind")).when(F.col("check_kind").isin(*VALIDATIONS), "check").otherwise(F.col("tool_kind"))
    return rows.select(F.concat_ws("/", "attempt_id", "unit_kind", "first_event").alias("unit_id"), "attempt_id", "seq", "unit_kind", "role", "episode", "tool_name", "tool_kind", "command_head", "check_kind", action.alias("category"), "status", "t_ms", "first_event")


def episode_summaries(rows: DataFrame) -> DataFrame:
    """Per episode: units, tools by kind in order of frequency, failures and the checks that ran."""
    kinds = rows.where("unit_kind = 'tool'").groupBy("attempt_id", "episode", "tool_kind").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tool_kind"))), lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), x["tool_kind"])), ", ")
    verbs = kinds.groupBy("attempt_id", "episode").agg(text.alias("tools"))
    per = rows.groupBy("attempt_id", "episode").agg(F.count("*").alias("units"), F.count_if(F.col("status") == "failed").alias("failures"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("check_kind").isin(*VALIDATIONS), F.col("check_kind")))), ",").alias("checks"), F.min("t_ms").alias("t0_ms"), F.max("t_ms").alias("t1_ms"))
    return per.join(verbs, ["attempt_id", "episode"], "left")
