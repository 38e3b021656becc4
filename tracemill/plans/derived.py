"""Text functions over commands, payloads, paths and records that are made of each row's own words and values; the SQL
beside a query says what must come out in terms of the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import commands, text, walkers
from tracemill.operators import filters, qualification
from tracemill.plans.registry import query
from tracemill.sources import bundles
from tracemill.sources.tables import OPERATIONS_SQL, operations, table


def _word(k: int) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0)), F.lit(k)), F.lit("x"))


def _w(k: int) -> str:
    return f"coalesce(regexp_extract_all(text, '[a-z]{{3,}}')[{k}], 'x')"


_WORDS = f"SELECT *, {_w(1)} AS w1, {_w(2)} AS w2, {_w(3)} AS w3, {_w(4)} AS w4"


def _with_words(df: DataFrame) -> DataFrame:
    return df.select("*", *(_word(k).alias(f"w{k}") for k in (1, 2, 3, 4)))


def _by(k: Column, *values: Column | str) -> Column:
    """The value that a number picks."""
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (k % len(values) + 1).cast("int"))


@query(f"""
WITH d AS ({_WORDS}, length(text) % 6 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id,
  ['', 'test,lint', '', '', 'test', 'typecheck'][k + 1] AS checks,
  ['src/' || w4 || '.ts', '', 'src/' || w3 || '/' || w4 || '.py', 'docs/' || w2 || '.md,' || w3 || '.json', 'out/' || w3 || '.json', ''][k + 1] AS writes,
  ['git ' || w2, 'pnpm run test', 'sed', 'mv ' || w1 || '.md', 'python -m pytest', 'npx tsc'][k + 1] AS head_of,
  ['vcs', 'test', 'inspect', 'other', 'test', 'typecheck'][k + 1] AS primary_check
FROM d
""")
def commands_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = commands.udfs(spark)
    w = [F.col(f"w{k}") for k in (1, 2, 3, 4)]
    forms = (
        F.concat(F.lit("cd "), w[0], F.lit(" && git "), w[1], F.lit(" && echo "), w[2], F.lit(" > src/"), w[3], F.lit(".ts")),
        F.concat(F.lit("pnpm run test "), w[0], F.lit(" && npx eslint src/"), w[1], F.lit(".ts")),
        F.concat(F.lit("sed -i s/"), w[0], F.lit("/"), w[1], F.lit("/ src/"), w[2], F.lit("/"), w[3], F.lit(".py")),
        F.concat(F.lit("mv "), w[0], F.lit(".md docs/"), w[1], F.lit(".md; rm -f "), w[2], F.lit(".json | cat")),
        F.concat(F.lit("python -m pytest tests/"), w[0], F.lit(".py -k "), w[1], F.lit(" > out/"), w[2], F.lit(".json")),
        F.concat(F.lit("bash -lc 'CI=1 timeout 30 npx tsc --noEmit -p "), w[0], F.lit(" | tail -"), F.length("text").cast("string"), F.lit("'")),
    )
    rows = _with_words(table(spark, sf_dir, "documents").where("text IS NOT NULL")).select("doc_id", _by(F.length("text"), *forms).alias("c"))
    return rows.select("doc_id", F.array_join(f["check_kinds"]("c"), ",").alias("checks"), F.array_join(f["shell_writes"]("c"), ",").alias("writes"), f["command_head"]("c").alias("head_of"), f["primary_check"]("c").alias("primary_check"))


@query(f"""
WITH t AS ({_WORDS}, substr(text, 1, length(text) // 2) AS old FROM conversations WHERE length(text) > 1)
SELECT conv_id, turn, concat_ws(chr(10), 'git', w1, '/' || w2, old, text, text) AS result, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS added, CAST(length(old) - length(replace(old, chr(10), '')) + 1 AS BIGINT) AS removed,
       '/' || w2 AS folders, 'git ' || w1 AS command, text || chr(10) || w3 AS visible
FROM t
""")
def payloads_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call whose arguments, edits and output are the turn's text, and a message with a hidden block of it."""
    f, c = walkers.udfs(spark), commands.udfs(spark)
    turns = _with_words(table(spark, sf_dir, "conversations").where("length(text) > 1"))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    payload = F.struct(F.array(F.lit("git"), F.col("w1")).alias("command"), F.concat(F.lit("/"), "w2").alias("cwd"), half.alias("old_string"), F.col("text").alias("new_string"), F.col("text").alias("output"), F.lit("x").alias("toolCallId"))
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    message = F.array(block("text", F.col("text")), block("thinking", F.col("text")), block("text", F.col("w3")))
    rows = turns.select("conv_id", "turn", F.to_json(payload).alias("p"), F.to_json(message).alias("m")).withColumn("e", f["edit_lines"]("p"))
    return rows.select("conv_id", "turn", f["result_text"]("p").alias("result"), "e.added", "e.removed", F.array_join(f["folders"]("p"), ",").alias("folders"), c["find_command"]("p").alias("command"), f["visible_text"]("m").alias("visible"))


_NAMES = "n AS (SELECT list(w ORDER BY length(w) DESC, w) AS ws FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark ORDER BY length(w) DESC, w LIMIT 20))"


@query(f"""
WITH {_NAMES}
SELECT doc_id, list_reduce(list_prepend(text, list_transform(ws, lambda w, i: w || '=' || i)), lambda t, x: replace(t, split_part(x, '=', 1), 'model-' || split_part(x, '=', 2))) AS blinded FROM documents, n WHERE text IS NOT NULL
""")
def blinded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the twenty longest words of the benchmark, as if they were models' names; longer ones go first."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    names = [r["w"] for r in words.orderBy(F.length("w").desc(), "w").limit(20).collect()]  # a fixed number of names
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", walkers.blinded(spark, {w: f"model-{k + 1}" for k, w in enumerate(names)})(F.col("text")).alias("blinded"))


@query(f"""
WITH d AS ({_WORDS}, length(text) % 4 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, ['src/' || w1 || '/' || w2 || '.test.tsx', w1 || '/' || w2 || '.md', w1, w2 || '/' || w3 || '/.' || w4][k + 1] AS hint,
       ['src/' || w1 || '/*.tsx (test)', w1 || '/*.md', './' || w1, w2 || '/' || w3 || '/*'][k + 1] AS target_class
FROM d
""")
def paths_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.concat
    forms = (j(F.lit("/workspace/repo/src/"), "w1", F.lit("/"), "w2", F.lit(".test.tsx")), j(F.lit(".\\"), "w1", F.lit("\\"), "w2", F.lit(".md")), F.col("w1"), j(F.lit("/"), "w1", F.lit("//"), "w2", F.lit("/"), "w3", F.lit("/."), "w4"))
    rows = _with_words(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    rows = rows.select("doc_id", text.path_hint(_by(F.length("text"), *forms)).alias("hint"))
    return rows.withColumn("target_class", text.target_class(F.col("hint")))


@query("""
SELECT conv_id, turn, CASE WHEN length(text) % 4 < 3 THEN CAST(length(text) % 300 - 20 AS BIGINT) END AS exit_code,
       CASE WHEN regexp_matches(cell, '^[=+@\\-\\t\\r]') THEN '''' || cell ELSE cell END AS cell,
       'received-' || role AS receipt_status, '{"bytes":' || length(text) || ',"status":"received-' || role || '"}' AS receipt
FROM (SELECT *, ['=', '+', '-', '@', ''][length(text) % 5 + 1] || text AS cell FROM conversations WHERE text IS NOT NULL)
""")
def outputs_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes that follow a turn's text, cells that begin with a sign, receipts with its size and role."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    size = F.length("text")
    code = (size % 300 - 20).cast("string")
    said = F.concat(F.lit("exit status 77\n"), "text", _by(size, F.concat(F.lit("\nExit code: "), code), F.concat(F.lit(" process exited with code "), code), F.concat(F.lit("\ncommand failed with exit code = "), code), " nothing"))
    said = F.when(size % 4 == 3, F.concat("text", F.lit(" exit code unknown"))).otherwise(said)
    doc = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("received-"), "role").alias("status"), size.alias("bytes")).alias("receipt")).alias("telemetry")))
    rows = turns.select("conv_id", "turn", commands.reported_exit_code(said).alias("exit_code"), text.csv_safe(F.concat(_by(size, "=", "+", "-", "@", ""), F.col("text"))).alias("cell"), doc.alias("doc"))
    return bundles.telemetry_receipts(rows, "doc").drop("doc")


@query(f"""
WITH {OPERATIONS_SQL}
SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'signup' THEN 'other' ELSE event_type END, CASE WHEN input_digest % 3 > 0 THEN tool_name END, CASE WHEN failed THEN 'error' ELSE '' END], lambda x: x IS NOT NULL AND x NOT IN ('', 'other')), ' · ') AS label,
       CASE event_type WHEN 'signup' THEN 'compaction' WHEN 'click' THEN 'edit:' || tool_name || ':src/' || input_digest || '.ts' WHEN 'view' THEN 'read:' || CASE WHEN input_digest % 2 = 0 THEN 'cat' ELSE tool_name END || ':' WHEN 'error' THEN 'check:' || tool_name ELSE 'other:?' END AS signature,
       failed OR input_digest % 4 > 0 AS failure, event_type = 'signup' AND input_digest % 2 = 0 AS compaction
FROM operations
""")
def labels_of_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    kind, k, tool = F.col("event_type"), F.col("input_digest"), F.col("tool_name")
    label = text.structural_label(F.when(kind == "signup", "other").otherwise(kind), F.when(k % 3 > 0, tool), F.when(F.col("failed"), "error").otherwise(""))
    category = F.when(kind == "click", "edit").when(kind == "view", "read").when(kind == "error", "check").otherwise("other")
    head = F.when((kind == "view") & (k % 2 == 0), "cat").otherwise("")
    signature = text.action_signature(F.when(kind == "signup", "compaction").otherwise("tool"), category, head, F.when(kind != "purchase", tool), F.when(kind == "click", F.concat(F.lit("src/"), k.cast("string"), F.lit(".ts"))))
    given = F.map_filter(F.create_map(F.lit("status"), F.when(F.col("failed"), "Errored").otherwise(kind), F.lit("exitCode"), (k % 4).cast("string"), F.lit("subtype"), F.when(k % 2 == 0, "Compact_boundary")), lambda _, v: v.isNotNull())
    return ops.select("event_id", label.alias("label"), signature.alias("signature"), filters.explicit_failure(given).alias("failure"), filters.compaction(F.when(kind == "signup", "context").otherwise("tool"), given).alias("compaction"))


_ENDS_SQL = """
o AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'stopped' WHEN month(o_orderdate) % 3 = 0 THEN 'failed' WHEN month(o_orderdate) % 3 = 1 THEN 'interrupted' ELSE 'completed' END AS harness,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'policy' WHEN '2-HIGH' THEN 'budget' END AS stop, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'not-run' WHEN '5-LOW' THEN NULL ELSE 'passed' END AS verifier,
         CASE WHEN day(o_orderdate) > 2 THEN o_totalprice > 150000 END AS retained FROM orders
)"""


@query(f"""
WITH {_ENDS_SQL}
SELECT o_orderkey, CASE WHEN harness = 'stopped' AND stop IS NOT NULL THEN 'stopped/' || stop || '/harness' WHEN harness IN ('failed', 'stopped') THEN 'failed/infrastructure/harness' WHEN harness = 'interrupted' THEN 'interrupted/infrastructure/harness'
  WHEN verifier = 'failed' THEN 'failed/task/verifier' WHEN verifier = 'not-run' THEN 'failed/infrastructure/verifier' WHEN retained THEN 'completed/none/runner' ELSE 'failed/infrastructure/workspace' END AS ends FROM o
""")
def ends_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, month = F.col("o_orderpriority"), F.month("o_orderdate") % 3
    harness = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "stopped").when(month == 0, "failed").when(month == 1, "interrupted").otherwise("completed")
    stop = F.when(priority == "1-URGENT", "policy").when(priority == "2-HIGH", "budget")
    verifier = F.when(priority == "3-MEDIUM", "failed").when(priority == "4-NOT SPECIFIED", "not-run").when(priority == "5-LOW", None).otherwise("passed")
    retained = F.when(F.dayofmonth("o_orderdate") > 2, F.col("o_totalprice") > 150000)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", qualification.terminal(harness, stop, verifier, retained).alias("end"))
    return rows.select("o_orderkey", F.concat_ws("/", "end.state", "end.failure_class", "end.source").alias("ends"))


@query(f"""
WITH {OPERATIONS_SQL}
SELECT event_id, CASE event_type
  WHEN 'view' THEN 'read src/' || tool_name || '/*.md'
  WHEN 'click' THEN 'edit lib/*.py (' || CASE WHEN input_digest > 80 THEN 'large rewrite' WHEN input_digest > 10 THEN 'medium edit' ELSE 'small edit' END || ')'
  WHEN 'error' THEN 'run `make ' || tool_name || '`' || CASE WHEN input_digest % 2 = 0 THEN ' (test + lint)' ELSE '' END || CASE WHEN input_digest % 3 = 0 THEN ' — writes src/*.ts (+1 more)' ELSE '' END || ' — failed: code ' || input_digest
  WHEN 'purchase' THEN 'use tool ' || tool_name ELSE 'context compacted: ' || tool_name END || CASE WHEN value >= 30 AND event_type <> 'signup' THEN ' [long-running]' ELSE '' END AS sentence
FROM operations
""")
def sentences_of_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    kind, k, tool = F.col("event_type"), F.col("input_digest"), F.col("tool_name")
    none, names = F.lit(None).cast("string"), F.array().cast("array<string>")
    unit = {
        "unit_kind": F.when(kind == "signup", "compaction").otherwise("tool"), "role": none, "text": F.when(kind == "signup", tool), "summary": none, "subkind": none,
        "tool_kind": F.when(kind == "view", "read").when(kind == "click", "edit").when(kind == "error", "shell").otherwise("other"), "tool_name": tool,
        "command_head": F.when(kind == "error", F.concat(F.lit("make "), tool)), "check_kinds": F.when(k % 2 == 0, F.array(F.lit("test"), F.lit("lint"))).otherwise(names),
        "writes": F.when(k % 3 == 0, F.array(F.lit("src/a.ts"), F.lit("b.ts"))).otherwise(names),
        "target": F.when(kind == "view", F.concat(F.lit("src/"), tool, F.lit("/x.md"))).when(kind == "click", F.lit("lib/x.py")), "lines_changed": k,
        "status": F.when(F.col("failed"), "error").otherwise("ok"), "error_signature": F.concat(F.lit("code "), k.cast("string")), "duration_seconds": F.col("value"),
    }
    return ops.select("event_id", text.embed_text(unit).alias("sentence"))
