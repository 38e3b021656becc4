"""Queries over bundles' manifests and documents, JSON payloads, attributes, ends of attempts, budgets and sets.

Where the driver's tables hold no such values, every row gets one of a list of cases by its id, and the SQL
has the value that each case must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import commands, text, walkers
from tracemill.operators import evaluations, filters, qualification, sampling, sequences, sets
from tracemill.plans.registry import query
from tracemill.sources import bundles, scratch
from tracemill.sources.tables import ATTEMPTS_SQL, attempts, table


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (bool, int)) else "'" + str(x).replace("'", "''") + "'"


def _expected(cases: list[tuple], names: str) -> str:
    """SQL for each event with the values that its case, all but the first ``given`` columns, must give."""
    rows = ", ".join(f"({k}, {', '.join(map(_literal, row))})" for k, row in enumerate(cases))
    return f"SELECT e.event_id, {', '.join('v.' + n.strip() for n in names.split(',') if not n.strip().startswith('_'))} FROM events e JOIN (VALUES {rows}) v(k, {names}) ON e.event_id % {len(cases)} = v.k"


def _case(cases: list[tuple], column: int, kind: str = "string") -> Column:
    values = F.array(*(F.lit(row[column]).cast(kind) for row in cases))
    return F.element_at(values, (F.col("event_id") % len(cases) + 1).cast("int"))


# manifests


@query(f"""
WITH {ATTEMPTS_SQL}
SELECT attempt_id AS manifest, CASE WHEN attempt_id % 50 <> 0 THEN CAST(attempt_id AS VARCHAR) END AS attempt_id,
  CASE WHEN attempt_id % 50 <> 0 AND attempt_id % 7 <> 0 THEN CAST(run_id AS VARCHAR) END AS run_id,
  CASE WHEN attempt_id % 50 = 0 THEN 'unavailable' WHEN attempt_id % 3 = 0 THEN 'qualified' WHEN attempt_id % 3 = 1 THEN 'legacy' ELSE 'unavailable' END AS capture_qualification,
  CASE WHEN attempt_id % 50 = 0 THEN '' WHEN attempt_id % 2 = 0 THEN 'passed' ELSE 'failed,passed' END AS verifier_statuses,
  CASE WHEN attempt_id % 50 = 0 THEN 'manifest:not valid JSON,run_id:missing,attempt_id:missing,terminal_state:missing' WHEN attempt_id % 7 = 0 THEN 'run_id:missing' ELSE '' END AS issues
FROM attempts
""".replace("manifest:not valid JSON,run_id:missing,attempt_id:missing,terminal_state:missing", "manifest:not valid JSON"))
def corpus_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of manifests, stored as canonical JSON lines and read again; every 50th manifest is cut off."""
    a, n = attempts(spark, sf_dir), F.col("attempt_id")
    word = lambda c: F.col(c).cast("string")
    mine, other = F.concat(F.lit("w"), word("attempt_id")), F.lit("elsewhere")
    verifier = lambda status, where: F.struct(F.lit("verifier").alias("kind"), F.lit(status).alias("status"), where.alias("workspaceArtifactId"))
    manifest = F.struct(
        F.struct(F.when(n % 7 != 0, word("run_id")).alias("id")).alias("run"),
        F.struct(word("attempt_id").alias("id"), F.col("attempt_number").alias("number")).alias("attempt"),
        F.struct(F.col("terminal_state").alias("state"), mine.alias("workspaceArtifactId")).alias("terminal"),
        F.struct(
            F.when(n % 3 <= 1, "legacy").alias("status"),
            F.when(n % 3 == 0, F.struct(F.lit("qualified").alias("status"))).alias("structural"),
        ).alias("qualification"),
        F.array_compact(F.array(verifier("passed", mine), F.when(n % 2 == 1, verifier("failed", mine)), verifier("error", other))).alias("evidence"),
    )
    found = a.select(word("attempt_id").alias("manifest_path"), F.when(n % 50 == 0, '{"bundleId":').otherwise(F.to_json(manifest)).alias("text"))
    index, path = bundles.corpus_index(found), scratch.folder(spark, "index")
    bundles.write_index(index, path)
    back = bundles.read_index(spark, path, index.schema).where("broken IS NULL")
    issues = F.array_join(F.transform("issues", lambda i: F.concat(i["field"], F.lit(":"), i["message"])), ",")
    return back.select(F.col("manifest_path").cast("long").alias("manifest"), "attempt_id", "run_id", "capture_qualification", F.array_join("verifier_statuses", ",").alias("verifier_statuses"), issues.alias("issues"))


# a document, its receipt's status and its receipt
_RECEIPTS = [
    ('{"telemetry":{"receipt":{"status":"received","bytes":12}}}', "received", '{"bytes":12,"status":"received"}'),
    ('{"telemetry":{"receipt":{"status":"timed-out"}}}', "timed-out", '{"status":"timed-out"}'),
    ('{"telemetry":{"receipt":"received"}}', "absent", None),
    ('{"telemetry":{}}', "absent", None),
    ("[1]", "absent", None),
    ("no JSON", "absent", None),
]


@query(_expected(_RECEIPTS, "_document, receipt_status, receipt"))
def telemetry_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", _case(_RECEIPTS, 0).alias("d"))
    return bundles.telemetry_receipts(rows, "d").drop("d")


@query("""
SELECT 'user-' || user_id AS path, 'line:' || event_id AS locator, CASE WHEN event_id % 11 = 0 THEN 'not-json' ELSE 'sequence-differs' END AS problem
FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0
""")
def session_envelope_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    line = F.to_json(F.struct(F.when(n % 7 == 0, n + 1).when(n % 5 != 0, n).alias("sequence"), "event_type"))
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("line:"), n.cast("string")).alias("locator"), F.when(n % 11 == 0, F.concat(line, F.lit("}"))).otherwise(line).alias("text"))
    return bundles.envelope_breaches(lines)


# payloads


_MESSAGES = [
    ('"plain words"', "plain words"),
    ('[{"type":"text","text":"hello"},{"type":"thinking","thinking":"hidden"},{"type":"tool_use","input":{"text":"no"}},{"type":"text","text":"there"}]', "hello|there"),
    ('{"role":"assistant","content":[{"type":"userMessage","text":"nested"}],"note":"a string inside"}', "nested"),
    ('{"channel":"analysis","content":{"type":"text","text":"hidden"}}', ""),
    ('{"type":"agentMessage","text":"said"}', "said"),
    ("null", ""),
]


@query(_expected(_MESSAGES, "_payload, visible"))
def visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = walkers.udfs(spark)
    return table(spark, sf_dir, "events").select("event_id", F.replace(f["visible_text"](_case(_MESSAGES, 0)), F.lit("\n"), F.lit("|")).alias("visible"))


# a payload, its strings, the lines it adds and removes, the folders and the command that it names
_PAYLOADS = [
    ('{"output":"done","toolCallId":"x1","cwd":"/w"}', "done|/w", 0, 0, "/w", None),
    ('{"file":"a.py","old_string":"x\\ny","new_string":"z"}', "a.py|x|y|z", 1, 2, "", None),
    ('{"command":["git","status"],"workdir":"/r","deep":{"root":"/s","cwd":"/r"}}', "git|status|/r|/s|/r", 0, 0, "/r,/s", "git status"),
    ('{"arguments":"{\\"cmd\\":\\"make all\\"}"}', '{"cmd":"make all"}', 0, 0, "", "make all"),
    ('{"patch":"*** Begin Patch\\n+one\\n+two\\n-three\\n+++ b"}', "*** Begin Patch|+one|+two|-three|+++ b", 2, 1, "", None),
    ('{"output":{"command":"not this"},"call":{"command":"  ","inner":{"cmd":"ls"}}}', "not this|  |ls", 0, 0, "", "ls"),
    ("null", "", 0, 0, "", None),
]


@query(_expected(_PAYLOADS, "_payload, result, added, removed, folders, command").replace("v.added", "CAST(v.added AS BIGINT) AS added").replace("v.removed", "CAST(v.removed AS BIGINT) AS removed"))
def tool_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = walkers.udfs(spark), commands.udfs(spark)
    rows = table(spark, sf_dir, "events").select("event_id", _case(_PAYLOADS, 0).alias("p"))
    rows = rows.withColumn("e", f["edit_lines"]("p"))
    return rows.select("event_id", F.replace(f["result_text"]("p"), F.lit("\n"), F.lit("|")).alias("result"), "e.added", "e.removed", F.array_join(f["folders"]("p"), ",").alias("folders"), c["find_command"]("p").alias("command"))


_MODELS = {"gpt-x": "model-a", "gpt-x-pro": "model-b"}
_NAMED = [
    ('{"gpt-x":"asks gpt-x-pro","n":[1,"gpt-x"]}', '{"model-a":"asks model-b","n":[1,"model-a"]}'),
    ('{"b":1,"a":"gpt-y"}', '{"a":"gpt-y","b":1}'),
    ("plain gpt-x text", "plain model-a text"),
]


@query(_expected(_NAMED, "_document, blinded"))
def blinded_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", walkers.blinded(spark, _MODELS)(_case(_NAMED, 0)).alias("blinded"))


# texts


_TARGETS = [
    ("/workspace/repo/src/app/components/Button.test.tsx", "app/components/Button.test.tsx", "app/components/*.tsx (test)"),
    ("README", "README", "./README"),
    ("C:\\w\\src\\main.rs", "w/src/main.rs", "w/src/*.rs"),
    ("./.env", ".env", "./.env"),
    (".", None, None),
]


@query(_expected(_TARGETS, "_path, hint, target_class"))
def path_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", text.path_hint(_case(_TARGETS, 0)).alias("hint"))
    return rows.withColumn("target_class", text.target_class(F.col("hint")))


_OUTPUTS = [("Exit code: 2", 2), ("exit status 1, then Process exited with code 0", 0), ("all well", None), ("exited with code -9", -9), ("command failed with exit code = 127", 127)]


@query(_expected(_OUTPUTS, "_output, exit_code").replace("v.exit_code", "CAST(v.exit_code AS BIGINT) AS exit_code"))
def reported_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", commands.reported_exit_code(_case(_OUTPUTS, 0)).alias("exit_code"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 401 THEN text ELSE substr(text, 1, 200) || chr(10) || '[… ' || (length(text) - 400) || ' characters …]' || chr(10) || substr(text, length(text) - 199) END AS text FROM documents
""")
def bounded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text"), 401).alias("text"))


_CELLS = [("=1+2", "'=1+2"), ("+4", "'+4"), ("-x", "'-x"), ("@f", "'@f"), ("a=b", "a=b"), ("", "")]


@query(_expected(_CELLS, "_cell, safe"))
def csv_guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.csv_safe(_case(_CELLS, 0)).alias("safe"))


_UNITS = [("tool", None, "shell", "test", "error", "tool · shell · test · error"), ("message", "user", None, None, "ok", "message · user · ok"), ("tool", "", "other", "other", "ok", "tool · ok"), (None, None, None, None, None, "")]


@query(_expected(_UNITS, "_kind, _role, _tool, _check, _status, label"))
def restricted_unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.structural_label(*(_case(_UNITS, k) for k in range(5))).alias("label"))


# attributes, ranges, ends

_ATTRIBUTES = [
    ("{}", "tool", False, False),
    ('{"status":"FAILED"}', "tool", True, False),
    ('{"isError":"true"}', "tool", True, False),
    ('{"errorScope":"call"}', "tool", True, False),
    ('{"hook":"PostToolUseFailure"}', "tool", True, False),
    ('{"exitCode":"0","status":"ok"}', "tool", False, False),
    ('{"exitCode":"3"}', "tool", True, False),
    ('{"exitCode":"x"}', "tool", False, False),
    ('{"subtype":"compact_boundary"}', "context", False, True),
    ('{"subtype":"compact_boundary"}', "message", False, False),
    ('{"hook":"PreCompact"}', "lifecycle", False, True),
]


@query(_expected(_ATTRIBUTES, "_attributes, _family, failure, compaction"))
def attribute_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(_case(_ATTRIBUTES, 0), "map<string, string>").alias("a"), _case(_ATTRIBUTES, 1).alias("family"))
    return rows.select("event_id", filters.explicit_failure(F.col("a")).alias("failure"), filters.compaction(F.col("family"), F.col("a")).alias("compaction"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'signup') AND user_id IN (SELECT DISTINCT user_id FROM events WHERE user_id < 40) AND value >= 20 AND value <= 90")
def lists_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"event_type": ["error", "signup"], "user_id": list(range(40)), "props": []}
    return filters.matches_lists(table(spark, sf_dir, "events"), lists, "value", 20.0, 90.0).select("event_id", "event_type", "value")


_ENDS = [
    ("failed", None, "passed", True, "failed/infrastructure/harness"),
    ("stopped", "policy", "passed", True, "stopped/policy/harness"),
    ("stopped", "budget", None, True, "stopped/budget/harness"),
    ("stopped", None, None, True, "failed/infrastructure/harness"),
    ("interrupted", None, "failed", True, "interrupted/infrastructure/harness"),
    ("completed", None, "failed", True, "failed/task/verifier"),
    ("completed", None, "not-run", True, "failed/infrastructure/verifier"),
    ("completed", None, "passed", True, "completed/none/runner"),
    ("completed", None, None, True, "completed/none/runner"),
    ("completed", None, "passed", False, "failed/infrastructure/workspace"),
    ("completed", None, None, None, "failed/infrastructure/workspace"),
]


@query(_expected(_ENDS, "_harness, _stop, _verifier, _retained, ends"))
def terminal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = qualification.terminal(*(_case(_ENDS, k) for k in range(3)), _case(_ENDS, 3, "boolean"))
    rows = table(spark, sf_dir, "events").select("event_id", end.alias("end"))
    return rows.select("event_id", F.concat_ws("/", "end.state", "end.failure_class", "end.source").alias("ends"))


@query("""
SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 5 = 0 THEN 'unqualified' WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'qualified-with-gaps' ELSE 'qualified' END AS status,
  o_orderkey % 5 <> 0 AS semantic_usable,
  array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'CAPTURE_REPORT_CONTRADICTS_SOURCE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'CAPTURE_REPORT_MISSING' END,
    CASE WHEN o_orderkey % 2 = 0 THEN 'EVENT_LOG_COMPLETENESS_UNPROVEN' END], lambda x: x IS NOT NULL), ',') AS codes
FROM orders
""")
def capture_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = table(spark, sf_dir, "orders").select(k.alias("attempt_id"), (k % 3 == 0).alias("report_missing"), (k % 5 == 0).alias("report_contradicts"), F.when(k % 2 == 0, True).alias("log_incomplete"))
    return qualification.qualify(flags).withColumn("codes", F.array_join("codes", ","))


# answers

_ANSWERS_SQL = """
SELECT l_orderkey AS assertion, l_linestatus = 'F' AS done,
  l_returnflag = 'A' AND l_linenumber / 5.0 >= 0.8 AS ok FROM lineitem
"""


@query(f"""
SELECT assertion, count(*) AS claims, count(*) FILTER (done) AS checked, count(*) FILTER (NOT done) AS failed_decisions,
  count(*) FILTER (done AND ok) AS supported, count(*) FILTER (done AND NOT ok) AS flagged FROM ({_ANSWERS_SQL}) GROUP BY assertion
""")
def claim_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "contradicted")
    answers = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("assertion"),
        F.col("l_linenumber").alias("claim"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"),
        label.alias("label"),
        (F.col("l_linenumber") / 5).alias("confidence"),
    )
    return qualification.claim_checks(answers)


@query("""
SELECT o_orderpriority AS dimension, count(*) AS asked, count(*) FILTER (o_orderkey % 3 <> 0) AS answered,
  count(*) FILTER (o_orderkey % 3 = 1) AS decided, count(*) FILTER (o_orderkey % 3 = 2) AS deferred FROM orders GROUP BY ALL
""")
def question_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k.alias("occurrence"), F.col("o_orderpriority").alias("dimension"))
    status = F.when(F.col("occurrence") % 3 == 1, "decided").otherwise("deferred")
    return evaluations.coverage(asked.where("occurrence % 3 <> 0").withColumn("status", status), asked)


# channels and sets


@query("""
WITH p AS (
  SELECT l.event_id AS left_id, r.event_id AS right_id, 'call' AS key FROM events l JOIN events r ON l.event_id // 2 = r.event_id // 2 WHERE l.event_id % 2 = 0 AND r.event_id % 2 = 1 AND l.event_id % 6 < 4
  UNION ALL SELECT l.event_id, r.event_id, 'said' FROM events l JOIN events r ON l.user_id = r.user_id AND l.value = r.value WHERE l.event_id % 2 = 0 AND r.event_id % 2 = 1
)
SELECT left_id, right_id, string_agg(key, ',' ORDER BY key) AS keys FROM p GROUP BY ALL
""")
def correlated_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id"), F.col("id")
    pair = F.floor(n / 2)
    keys = {"call": F.when(pair % 3 < 2, pair), "said": F.concat_ws("|", F.col("user_id").cast("string"), F.col("value").cast("string"))}
    found = sequences.correlate(rows.where(n % 2 == 0), rows.where(n % 2 == 1), keys)
    return found.select("left_id", "right_id", F.array_join("by", ",").alias("keys"))


@query("""
WITH l AS (SELECT user_id, event_type FROM events WHERE event_id % 7 <> 0), r AS (SELECT user_id, event_type FROM events WHERE event_id % 5 <> 0)
SELECT *, 'left' AS only_in FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)
""")
def rule_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    side = lambda n: rows.where(F.col("event_id") % n != 0).select("user_id", "event_type")
    return sets.same_set(side(7), side(5))


@query("""
WITH RECURSIVE items AS (
  SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS s, 1 + o_orderkey % 30 AS n FROM orders
), step AS (
  SELECT DISTINCT c, CAST(1 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, s BIGINT, n BIGINT)[]) AS taken, CAST(0 AS BIGINT) AS used FROM items
  UNION ALL
  SELECT t.c, CASE WHEN back THEN t.k ELSE t.k + 1 END,
    CASE WHEN back THEN taken[:-2] WHEN used + i.s <= 300 THEN list_append(taken, {'id': i.id, 's': i.s, 'n': i.n}) ELSE taken END,
    CASE WHEN back THEN used - taken[-1].s + taken[-1].n WHEN used + i.s <= 300 THEN used + i.s ELSE used + i.n END
  FROM (SELECT *, used > 300 AND len(taken) > 0 AS back FROM step) t LEFT JOIN items i ON i.c = t.c AND i.k = t.k WHERE back OR i.id IS NOT NULL
), ends AS (SELECT c, taken FROM step WHERE NOT (used > 300 AND len(taken) > 0) AND k > (SELECT max(k) FROM items i WHERE i.c = step.c))
SELECT i.c AS o_custkey, i.id AS o_orderkey, list_contains(list_transform(e.taken, lambda x: x.id), i.id) AS included FROM items i JOIN ends e ON i.c = e.c
""")
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as evidence with a budget of 300; sizes are thousands of their price."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("size"), (1 + F.col("o_orderkey") % 30).alias("note"))
    return sampling.pack_context(rows, "o_custkey", ["o_orderkey"], "size", "note", 300).drop("size", "note")
