"""Native records of each harness as normalized events: a rule table and a few projections, no walker per harness.

A rule says, for a harness and a native type (and subtype, where it matters), which family, phase and actor
the record has. The rules are a small table that is joined by broadcast; places of ids in a harness's
documents are JSON paths. A record without a rule is unmapped, with a reason, so that mapped and unmapped
records always make up what was captured.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import schemas
from tracemill.functions.text import parsed_json
from tracemill.operators.sequences import first_per_key, unique_lowest


@dataclass(frozen=True)
class Adapter:
    """Where a harness's records hold what an event needs. Paths are tried in order."""

    domain: str
    type: tuple[str, ...]
    subtype: tuple[str, ...] = ()
    order: tuple[str, ...] = ("$.sequence",)
    time: tuple[str, ...] = ()
    session: tuple[str, ...] = ()
    call: tuple[str, ...] = ()
    tool: tuple[str, ...] = ()
    parent: tuple[str, ...] = ()
    input: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)


# fixed values: where each harness's published records hold ids, times and arguments
ADAPTERS: dict[str, Adapter] = {
    "agent-sdk": Adapter("session", ("$.nativeType", "$.hook"), ("$.nativeSubtype", "$.message.subtype"), time=("$.message.timestamp", "$.capturedAt"), session=("$.sessionId", "$.message.session_id"), call=("$.message.tool_use_id", "$.input.tool_use_id"), tool=("$.message.tool_name", "$.input.tool_name"), parent=("$.message.parent_tool_use_id",), attributes={"taskId": "$.message.task_id", "hook": "$.hook", "totalCostUsd": "$.message.total_cost_usd"}),
    "codex": Adapter("app-server", ("$.method",), ("$.payload.item.type",), time=("$.observedAt",), session=("$.payload.threadId",), call=("$.payload.item.id",), tool=("$.payload.item.tool", "$.payload.item.type"), input=("$.payload.item.command", "$.payload.item.arguments", "$.payload.item.query"), attributes={"status": "$.payload.item.status", "exitCode": "$.payload.item.exitCode"}),
    "devin": Adapter("acp", ("$.payload.update.sessionUpdate", "$.method"), ("$.kind",), time=("$.observedAt",), session=("$.payload.sessionId",), call=("$.payload.update.toolCallId", "$.payload.toolCall.toolCallId"), tool=("$.payload.update.kind",), input=("$.payload.update.rawInput",), attributes={"status": "$.payload.update.status", "stopReason": "$.payload.stopReason"}),
    "factory": Adapter("stdio", ("$.frame.params.notification.type",), (), time=("$.observedAt",), session=("$.frame.params.sessionId",), call=("$.frame.params.notification.toolUse.id", "$.frame.params.notification.toolUseId"), tool=("$.frame.params.notification.toolUse.name",), input=("$.frame.params.notification.toolUse.input",), attributes={"isError": "$.frame.params.notification.isError", "messageId": "$.frame.params.notification.message.id"}),
    "openhands": Adapter("events", ("$.kind",), (), order=("$.sequence", "$.index"), time=("$.timestamp",), session=("$.conversation_id",), call=("$.tool_call_id", "$.action_id"), tool=("$.tool_name",), input=("$.action",), attributes={"nativeId": "$.id", "channel": "$.channel"}),
    "deepseek": Adapter("session", ("$.payload.event.type", "$.method"), (), order=("$.payload.event.sequence", "$.sequence"), time=("$.payload.event.timestamp",), session=("$.payload.sessionId",), call=("$.payload.event.toolCallId",), tool=("$.payload.event.toolName",), input=("$.payload.event.arguments",), attributes={"sourceSequence": "$.payload.event.sourceSequence"}),
    "pi": Adapter("pi", ("$.payload.type", "$.type"), ("$.payload.message.role", "$.message.role"), time=("$.timestamp", "$.receivedAt"), session=("$.sessionId",), call=("$.payload.toolCallId", "$.message.toolCallId"), tool=("$.payload.toolName", "$.message.toolName"), attributes={"responseId": "$.message.responseId", "channel": "$.channel"}),
    "cursor": Adapter("receipt", ("$.payload.message.type", "$.channel"), ("$.payload.message.status",), session=("$.sessionId", "$.runId"), call=("$.payload.message.call_id",), tool=("$.payload.message.name",), input=("$.payload.message.args",), attributes={"toolStatus": "$.payload.message.status"}),
}

# fixed values: native types and what they are. harness, native type, subtype (* any), family, phase, actor
RULES = """
agent-sdk assistant * message instant model
agent-sdk user * message instant user
agent-sdk result * outcome after harness
agent-sdk stream_event * message during model
agent-sdk tool_progress * tool during tool
agent-sdk tool_use_summary * tool after harness
agent-sdk auth_status * runtime instant harness
agent-sdk rate_limit_event * runtime instant harness
agent-sdk conversation_reset * context after harness
agent-sdk prompt_suggestion * message after harness
agent-sdk system compact_boundary context after harness
agent-sdk system task_started delegation before agent
agent-sdk system task_progress delegation during agent
agent-sdk system task_updated delegation during agent
agent-sdk system task_notification delegation during agent
agent-sdk system worker_shutting_down delegation during agent
agent-sdk system files_persisted artifact after harness
agent-sdk system permission_denied permission after harness
agent-sdk system init runtime instant harness
agent-sdk system status runtime instant harness
agent-sdk system notification runtime instant harness
agent-sdk PreToolUse * tool before harness
agent-sdk PostToolUse * tool after harness
agent-sdk PostToolUseFailure * tool after harness
agent-sdk PreCompact * context before harness
agent-sdk SubagentStart * delegation before harness
agent-sdk SubagentStop * delegation after harness
codex item/completed userMessage message after user
codex item/completed agentMessage message after agent
codex item/completed commandExecution tool after tool
codex item/completed mcpToolCall tool after tool
codex item/completed webSearch tool after tool
codex item/completed fileChange artifact after agent
codex item/completed reasoning context after agent
codex item/completed contextCompaction context after agent
codex turn/completed * outcome after harness
codex turn/plan/updated * context instant agent
codex thread/compacted * context instant agent
codex thread/tokenUsage/updated * runtime instant harness
codex model/rerouted * runtime instant harness
codex hook/completed * runtime instant harness
devin session/prompt request message before user
devin session/prompt response outcome after harness
devin session/request_permission * permission before harness
devin agent_message_chunk * message during agent
devin user_message_chunk * message during user
devin tool_call * tool before tool
devin tool_call_update * tool during tool
devin plan * context instant agent
devin usage_update * runtime instant harness
factory create_message * message after agent
factory assistant_text_delta * message during agent
factory tool_call * tool before agent
factory tool_result * tool after tool
factory session_compacted * context instant harness
factory settings_updated * context instant harness
factory llm_retry * context instant harness
factory session_token_usage_changed * context instant harness
factory permission_resolved * permission instant harness
factory child_session_available * delegation instant harness
factory agent_turn_completed * outcome after harness
openhands MessageEvent * message instant agent
openhands SystemPromptEvent * message instant agent
openhands ActionEvent * tool before agent
openhands ObservationEvent * tool after tool
openhands AgentErrorEvent * tool after tool
openhands UserRejectObservation * tool after user
openhands CondensationRequest * context before harness
openhands Condensation * context during harness
openhands CondensationSummaryEvent * context after harness
openhands ConversationStateUpdateEvent * runtime instant harness
deepseek user_message * message instant user
deepseek assistant_message * message instant model
deepseek request/model * model-request before harness
deepseek tool_call * tool before model
deepseek tool_result * tool after tool
deepseek compaction * context after harness
deepseek usage * runtime after harness
deepseek completed * outcome after harness
pi session * runtime instant harness
pi message assistant message after model
pi message user message after user
pi message toolResult message after tool
pi message bashExecution message after tool
pi message custom message after harness
pi compaction * context after harness
pi branch_summary * context after harness
pi tool_execution_start * tool before tool
pi tool_execution_end * tool after tool
pi agent_end * outcome after harness
cursor assistant * message instant model
cursor user * message instant user
cursor tool_call running tool before tool
cursor tool_call * tool after tool
cursor status * runtime instant harness
cursor result * outcome after harness
"""


def rules(spark) -> DataFrame:
    rows = [tuple(line.split()) for line in RULES.strip().splitlines()]
    return spark.createDataFrame(rows, "harness string, native_type string, rule_subtype string, family string, phase string, actor_kind string")


def _first(doc: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    found = [F.try_variant_get(doc, p, kind) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def _by_harness(pick) -> Column:
    """An expression of each adapter, by the row's harness."""
    out = F
    for name, adapter in ADAPTERS.items():
        out = out.when(F.col("harness") == name, pick(adapter))
    return out.otherwise(F.lit(None))


def event_id(discriminator: Column) -> Column:
    return F.concat(F.col("harness"), F.lit("-"), F.substring(F.sha2(F.concat_ws("\x00", "run_id", "attempt_id", "artifact_id", "locator", discriminator), 256), 1, 32))


def normalize(native: DataFrame) -> DataFrame:
    """native: schemas.NATIVE, doc being JSON. Returns schemas.EVENT, a row for each record that a rule covers,
    and one for each tool block of an agent SDK message."""
    v = F.col("__v")
    rows = native.withColumn("__v", parsed_json(F.col("doc")))
    attributes = _by_harness(lambda a: F.map_filter(F.create_map(*(x for k, p in {"toolName": a.tool, "callId": a.call, "sessionId": a.session, **{k: (p,) for k, p in a.attributes.items()}}.items() for x in (F.lit(k), _first(v, p)))), lambda _, y: y.isNotNull()))
    given = _by_harness(lambda a: _first(v, a.input, "variant").cast("variant") if a.input else F.lit(None).cast("variant"))
    rows = rows.select(
        *native.columns,
        "__v",
        _by_harness(lambda a: _first(v, a.type)).alias("native_type"),
        _by_harness(lambda a: _first(v, a.subtype)).alias("subtype"),
        F.coalesce(_by_harness(lambda a: _first(v, a.order, "bigint")), F.regexp_extract("locator", "line:(\\d+)", 1).try_cast("bigint")).alias("order_value"),
        _by_harness(lambda a: _first(v, a.time)).alias("event_time"),
        _by_harness(lambda a: _first(v, a.session)).alias("session"),
        _by_harness(lambda a: _first(v, a.call)).alias("call"),
        _by_harness(lambda a: _first(v, a.tool)).alias("actor_id"),
        _by_harness(lambda a: _first(v, a.parent)).alias("parent_key"),
        _by_harness(lambda a: F.lit(a.domain)).alias("domain"),
        attributes.alias("attributes"),
        F.to_json(given).alias("__input"),
    )
    digest = F.map_filter(F.create_map(F.lit("inputDigest"), F.when(F.col("__input").isNotNull(), F.concat(F.lit("sha256:"), F.sha2("__input", 256)))), lambda _, y: y.isNotNull())
    rows = rows.withColumn("attributes", F.map_concat("attributes", digest))
    # a rule for the subtype wins over one for any
    r = rules(native.sparkSession)  # the table above, broadcast as two lookups
    gives = F.struct(*(c for c in r.columns if c not in ("harness", "native_type", "rule_subtype")))
    exact = r.where("rule_subtype <> '*'").select("harness", "native_type", F.col("rule_subtype").alias("subtype"), gives.alias("__exact"))
    usual = r.where("rule_subtype = '*'").select("harness", "native_type", gives.alias("__usual"))
    found = rows.join(F.broadcast(exact), ["harness", "native_type", "subtype"], "left").join(F.broadcast(usual), ["harness", "native_type"], "left")
    best = found.withColumn("__rule", F.coalesce("__exact", "__usual")).where("__rule IS NOT NULL").select("*", "__rule.*")
    synthetic = F.when((F.col("harness") == "agent-sdk") & F.try_variant_get("__v", "$.message.isSynthetic", "boolean"), "harness").otherwise(F.col("actor_kind"))
    base = best.withColumn("actor_kind", synthetic).withColumn("id", event_id(F.lit("record")))
    blocks = F.try_variant_get("__v", "$.message.message.content", "array<variant>")
    tools = rows.where("harness = 'agent-sdk' AND native_type IN ('assistant', 'user')").select("*", F.posexplode(blocks).alias("n", "block"))
    get = lambda p, k="string": F.try_variant_get("block", p, k)
    tools = tools.withColumn("__kind", get("$.type")).where("__kind IN ('tool_use', 'tool_result')")
    use = F.col("__kind") == "tool_use"
    fields = {"toolName": get("$.name"), "callId": F.coalesce(get("$.id"), get("$.tool_use_id")), "isError": F.when(~use, F.coalesce(get("$.is_error", "boolean"), F.lit(False)).cast("string")), "inputDigest": F.when(use, F.concat(F.lit("sha256:"), F.sha2(F.to_json(get("$.input", "variant")), 256)))}
    made = F.map_filter(F.create_map(*(x for k, c in fields.items() for x in (F.lit(k), c))), lambda _, y: y.isNotNull())
    tools = (
        tools.withColumn("attributes", F.map_concat(F.map_filter("attributes", lambda k, _: ~k.isin(*fields)), made))
        .withColumn("call", fields["callId"])
        .withColumn("family", F.lit("tool"))
        .withColumn("phase", F.when(use, "before").otherwise("after"))
        .withColumn("actor_kind", F.when(use, "model").otherwise("tool"))
        .withColumn("actor_id", get("$.name"))
        .withColumn("id", event_id(F.concat(F.lit("block-"), F.col("n").cast("string"))))
    )
    return _shaped(base).unionByName(_shaped(tools))


def _shaped(rows: DataFrame) -> DataFrame:
    operation = (F.col("family") == "tool") & F.col("call").isNotNull()
    out = rows.withColumn("scope_kind", F.when(operation, "operation").when(F.col("session").isNotNull(), "session").otherwise("attempt"))
    out = out.withColumn("scope_id", F.when(operation, F.col("call")).otherwise(F.coalesce("session", "attempt_id")))
    out = out.withColumn("order_domain", F.when(F.col("order_value").isNotNull(), F.concat_ws(":", F.col("harness"), F.col("domain"), F.col("artifact_id"))))
    return out.select(*schemas.StructType.fromDDL(schemas.EVENT).names)


def unmapped(native: DataFrame, events: DataFrame) -> DataFrame:
    """Captured records that no event came from, with the reason."""
    key = ["run_id", "attempt_id", "artifact_id", "locator"]
    reason = F.when(parsed_json(F.col("doc")).isNull(), "not valid JSON").otherwise("no uniform mapping for this native type")
    return native.join(events.select(*key).distinct(), key, "left_anti").select(*key, reason.alias("reason"))


def parents(events: DataFrame) -> DataFrame:
    """Results point at the call with their id; the call is the one event that began it, and a tie gives none."""
    keyed = events.where("family = 'tool'").withColumn("key", F.coalesce(F.element_at("attributes", "callId"), F.lit(None)))
    began = keyed.where("phase = 'before' AND key IS NOT NULL").withColumn("rank", F.lit(0))
    anchor = unique_lowest(began, ["attempt_id", "key"], "rank", "id").withColumnRenamed("id", "parent_id")
    return keyed.where("phase <> 'before'").join(anchor, ["attempt_id", "key"]).select("attempt_id", "id", "parent_id")


def reconcile(events: DataFrame, native_id: Column, channel_rank: Column) -> DataFrame:
    """Of events that several channels report, the one of the best channel; events without a native id stay."""
    rows = events.withColumn("__id", native_id).withColumn("__channel", channel_rank)
    kept = first_per_key(rows.where("__id IS NOT NULL"), ["attempt_id", "__id"], [F.col("__channel"), F.col("id")])
    return kept.unionByName(rows.where("__id IS NULL")).drop("__id", "__channel")


def breaches(events: DataFrame, native: DataFrame) -> DataFrame:
    """What an adapter's output must not show: attempt, id and problem of every breach; empty if it keeps its contract."""
    at = ["attempt_id", "id"]

    def problem(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*at, F.lit(name).alias("problem"))

    seen = W.partitionBy("attempt_id", "id")
    repeated = events.withColumn("__n", F.count("*").over(seen)).where("__n > 1")
    key = ["run_id", "attempt_id", "artifact_id", "locator"]
    before = F.lag("order_value").over(W.partitionBy("attempt_id", "order_domain").orderBy(F.regexp_extract("locator", "line:(\\d+)", 1).try_cast("bigint"), "id"))
    late = events.where("order_domain IS NOT NULL").withColumn("__before", before).where("order_value < __before")
    wrong = events.where(~F.col("family").isin(*schemas.FAMILIES) | ~F.col("phase").isin(*schemas.PHASES) | ~F.col("actor_kind").isin(*schemas.ACTORS) | ~F.col("scope_kind").isin(*schemas.SCOPES))
    parts = [problem(repeated, "id-not-unique"), problem(events.join(native.select(*key), key, "left_anti"), "reference-not-captured"), problem(late, "order-decreases"), problem(wrong, "undeclared-value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
