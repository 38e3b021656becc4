"""What adapters carry from record to record: usage once a message, exits and parents of tool calls, chunks of messages,
one event from several channels, items that are open.

Each is a window over the records of an attempt that share a key (a message, a call, a native id), in capture order, so
the records of one attempt spread over as many tasks as it has keys, and nothing is held but a row and what the window
carries. Only running totals and chunks of messages are ordered within the attempt as a whole.

Native records are ``schemas.NATIVE``; capture order is the sequence where records have one, else the line. Records that
aren't JSON, or lack what a fold needs, are passed over; keys that are null make no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.text import parsed_json

AT = ["run_id", "attempt_id", "artifact_id", "locator"]
#: JSON numbers beyond this aren't whole numbers to the harnesses that write them.
SAFE = (1 << 53) - 1


def _get(path: str, kind: str = "string", doc: str = "__v") -> Column:
    return F.try_variant_get(doc, path, kind)


def _parsed(native: DataFrame, harness: str) -> DataFrame:
    line = F.regexp_extract("locator", "line:(\\d+)", 1).try_cast("bigint")
    # exploded, so that filters of what it holds stay above it: pushed below, each would parse the record again
    rows = native.where(F.col("harness") == harness).select("*", F.explode(F.array(parsed_json(F.col("doc")))).alias("__v")).where("__v IS NOT NULL")
    return rows.withColumn("__line", line).withColumn("__seq", F.coalesce(_get("$.sequence", "bigint"), line))


def _number(path: str) -> Column:
    """A JSON number as a double; strings that look like one aren't."""
    v = _get(path, "variant")
    return F.when(~F.schema_of_variant(v).isin("STRING", "BOOLEAN"), _get(path, "double"))


def token_count(path: str) -> Column:
    """A count of tokens: a whole number from 0 on; anything else is unknown."""
    n = _number(path)
    return F.when((n >= 0) & (n <= SAFE) & (n == F.floor(n)), n.cast("bigint"))


def request_usage(native: DataFrame) -> DataFrame:
    """An agent SDK's usage: one row for each provider message of an attempt, from the first record that has it, and the
    attempt's totals up to it. Output tokens are known for results only, so none are given."""
    rows = _parsed(native, "agent-sdk").where((F.col("kind") == "session") & (_get("$.nativeType") == "assistant"))
    message = _get("$.message.message.id")
    has = F.schema_of_variant(_get("$.message.message.usage", "variant")).startswith("OBJECT")
    rows = rows.where(has & (F.length(message) > 0)).withColumn("message_id", message)
    order = ["artifact_id", "__seq", "locator"]
    first = rows.withColumn("__k", F.row_number().over(W.partitionBy("run_id", "attempt_id", "message_id").orderBy(*order))).where("__k = 1")
    usage = "$.message.message.usage."
    parent = _get("$.message.parent_tool_use_id")
    found = first.select(
        *AT,
        "__seq",
        "message_id",
        _get("$.message.message.model").alias("model_id"),
        token_count(usage + "input_tokens").alias("input_tokens"),
        token_count(usage + "cache_read_input_tokens").alias("cache_read_tokens"),
        token_count(usage + "cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.when(F.length(parent) > 0, "subagent").otherwise("assistant").alias("usage_scope"),
    )
    total = W.partitionBy("run_id", "attempt_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("requests", F.count("*").over(total)).withColumn("total_input_tokens", F.sum("input_tokens").over(total)).drop("__seq")


def devin_calls(native: DataFrame) -> DataFrame:
    """A Devin session's tool calls and their ends. An end has the exit of its own record or the last one that an earlier
    update of its call carried, and points at the first record that began the call, if that came before it."""
    update = "$.payload.update"
    rows = _parsed(native, "devin").where((_get("$.method") == "session/update") & (_get("$.kind") == "notification"))
    rows = rows.select(*AT, "__seq", _get(f"{update}.sessionUpdate").alias("type"), _get(f"{update}.status").alias("status"), _get(f"{update}.toolCallId").alias("call_id"), _get(f"{update}._meta", "variant").alias("meta"), _get(f"{update}.rawInput", "variant").alias("input"))
    rows = rows.where("type IN ('tool_call', 'tool_call_update')")
    meta = lambda p, kind="string": F.try_variant_get("meta", p, kind)
    ended = F.schema_of_variant(meta("$.terminal_exit", "variant")).startswith("OBJECT") & (F.col("type") == "tool_call_update")
    end = F.when(ended, F.struct(meta("$.terminal_exit.exit_code", "bigint").alias("exit_code"), meta("$.terminal_exit.signal").alias("signal")))
    event = F.concat(F.lit("devin:"), F.col("__seq").cast("string"), F.lit(":"), F.col("type"))
    so_far = W.partitionBy("run_id", "attempt_id", "__call").orderBy("__seq", "locator").rowsBetween(W.unboundedPreceding, 0)
    # records without a call id carry nothing: each is a group of its own
    rows = rows.withColumn("__call", F.coalesce(F.concat(F.lit("c"), "call_id"), F.concat(F.lit("r"), "artifact_id", "locator"))).withColumn("id", event)
    rows = rows.withColumn("__exit", F.last(end, ignorenulls=True).over(so_far))
    began = F.first(F.when((F.col("type") == "tool_call") & F.col("call_id").isNotNull(), F.col("id")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("__parent", began)
    over = F.col("type") == "tool_call_update"
    return rows.where(~over | F.col("status").isin("completed", "failed")).select(
        *AT,
        F.col("__seq").alias("order_value"),
        "id",
        "call_id",
        F.when(over, "after").otherwise("before").alias("phase"),
        F.when(over, F.col("status")).alias("status"),
        meta("$['cognition.ai/inferenceToolName']").alias("tool_name"),
        F.coalesce(meta("$['cognition.ai/canceled']", "boolean") & over, F.lit(False)).alias("canceled"),
        F.when(over, F.col("__exit.exit_code")).alias("exit_code"),
        F.when(over, F.col("__exit.signal")).alias("signal"),
        F.when(over, F.col("__parent")).alias("parent_id"),
        F.when(~over & F.col("input").isNotNull(), F.concat(F.lit("sha256:"), F.sha2(F.to_json("input"), 256))).alias("input_digest"),
    )


def devin_messages(native: DataFrame) -> DataFrame:
    """Messages of a Devin session: neighbouring chunks of one speaker are one, until another update comes between."""
    update = "$.payload.update"
    rows = _parsed(native, "devin").where((_get("$.method") == "session/update") & (_get("$.kind") == "notification"))
    rows = rows.select(*AT, "__seq", _get(f"{update}.sessionUpdate").alias("type"), _get(f"{update}.content.text").alias("text"))
    speaker = F.when(F.col("type") == "agent_message_chunk", "agent").when(F.col("type") == "user_message_chunk", "user")
    w = W.partitionBy("run_id", "attempt_id").orderBy("__seq", "locator")
    rows = rows.withColumn("speaker", speaker)
    opens = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int")
    rows = rows.withColumn("__new", opens).withColumn("message", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("speaker IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("__seq", "locator", "text")))
    whole = rows.groupBy("run_id", "attempt_id", "message", "speaker").agg(F.count("*").alias("chunks"), F.min("__seq").alias("order_value"), parts.alias("parts"))
    return whole.select("run_id", "attempt_id", "order_value", "speaker", "chunks", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


#: Reasons of records from which no event comes.
DUPLICATE, NO_CONVERSATION, NO_MAPPING = "reconciled duplicate; final REST event is canonical", "capture ended before the conversation had an identity", "native record has no uniform mapping"


def openhands_canonical(native: DataFrame) -> DataFrame:
    """Every record of a server's two channels with native_id and canonical: of the records of one event, the last that
    REST gave, else the first from the socket; the rest with the reason why no event comes from them. An attempt in
    which no record names a conversation has no events."""
    rows = _parsed(native, "openhands").select(*AT, "__seq", _get("$.channel").alias("channel"), _get("$.session_id").alias("session"), _get("$.payload.id").alias("native_id"), _get("$.payload.kind").alias("native_type"))
    attempt = W.partitionBy("run_id", "attempt_id")
    rows = rows.withColumn("__known", F.max(F.col("session").isNotNull().cast("int")).over(attempt) == 1)
    rest, socket = F.col("channel") == "rest-event", F.col("channel") == "websocket-event"
    takes = rest | socket
    key = F.when(takes & (F.length("native_id") > 0), F.col("native_id"))
    rows = rows.withColumn("__key", F.coalesce(F.concat(F.lit("e"), key), F.concat(F.lit("r"), "artifact_id", "locator")))
    best = W.partitionBy("run_id", "attempt_id", "__key").orderBy(F.when(rest, 0).otherwise(1), F.when(rest, -F.col("__seq")).otherwise(F.col("__seq")), F.when(~rest, F.col("locator")), F.col("locator").desc())
    rows = rows.withColumn("__rank", F.row_number().over(best))
    canonical = F.col("__known") & ((key.isNotNull() & (F.col("__rank") == 1)) | (F.col("channel") == "conversation-final"))
    canonical = F.coalesce(canonical, F.lit(False))
    reason = F.when(canonical, None).when(~F.col("__known"), NO_CONVERSATION).when(socket & key.isNotNull(), DUPLICATE).otherwise(NO_MAPPING)
    return rows.select(*AT, "channel", "native_id", "native_type", canonical.alias("canonical"), reason.alias("reason"))


def open_items(events: DataFrame) -> DataFrame:
    """events: ``schemas.EVENT``. Every call of an attempt that began or ended: when, how many ends it has, whether it is
    still open or ended without a beginning, and how many others were open when it began."""
    rows = events.where("scope_kind = 'operation' AND phase IN ('before', 'after')").select("attempt_id", F.col("scope_id").alias("call_id"), "phase", "order_value", "id")
    before, after = F.col("phase") == "before", F.col("phase") == "after"
    calls = rows.groupBy("attempt_id", "call_id").agg(F.min(F.when(before, F.col("order_value"))).alias("began"), F.min(F.when(after, F.col("order_value"))).alias("ended"), F.count_if(after).alias("ends"))
    began = F.struct(F.col("began").alias("at"), F.lit(1).alias("step"))
    over = F.struct(F.col("ended").alias("at"), F.lit(-1).alias("step"))
    both = calls.where("began IS NOT NULL").select("*", F.explode(F.array(began, over)).alias("x")).where("x.at IS NOT NULL")
    running = F.sum("x.step").over(W.partitionBy("attempt_id").orderBy("x.at", "x.step", "call_id").rowsBetween(W.unboundedPreceding, 0))
    opened = both.withColumn("beside", running - 1).where("x.step = 1").select("attempt_id", "call_id", "beside")
    state = F.when(F.col("began").isNull(), "end-without-beginning").when(F.col("ended").isNull(), "open").when(F.col("ended") < F.col("began"), "ended-before").otherwise("ended")
    return calls.withColumn("state", state).join(opened, ["attempt_id", "call_id"], "left")
