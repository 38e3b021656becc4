"""Queries over texts, pages, JSON properties and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import commands, redaction, text
from tracemill.operators import vectors
from tracemill.plans.registry import query
from tracemill.sources.tables import table

_LINE = "(?i)(idiot|worthless|stupid)"


@query(f"""
WITH l AS (SELECT doc_id, trim(list_filter(regexp_split_to_array(substr(text, 1, 6000), '\\r?\\n'), lambda x: regexp_matches(x, '{_LINE}'))[1]) AS s FROM documents)
SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(s, '(?:[A-Za-z]:)?(?:/[\\w.@+-]+){{2,}}/?', '<path>', 'g'), '(?i)\\b[0-9a-f]{{8,}}\\b', '<hex>', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '<n>', 'g'), 1, 140) AS signature
FROM l WHERE s IS NOT NULL
""")
def error_signature_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.error_signature(F.col("text"), _LINE).alias("signature")).where("signature IS NOT NULL")


@query("""
SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM pages
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{vectors.WORD}')) AS BIGINT) AS words, CAST(len(list_distinct(regexp_extract_all(lower(text), '{vectors.WORD}'))) AS BIGINT) AS distinct_words FROM documents")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", vectors.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(CAST(json(props) AS VARCHAR)) AS digest FROM events")
def json_attribute_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.sha2(F.to_json("v"), 256).alias("digest"))


@query("""
SELECT user_id, event_id, 'user%20' || user_id || '/' || event_type || '/' || event_id AS event_key, 'ref-' || substr(sha256(event_type || event_id), 1, 20) AS reference,
       'sha256:' || sha256(props) AS digest FROM events
""")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    name = F.concat("event_type", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", text.event_key(user, F.col("event_type"), F.col("event_id")).alias("event_key"), text.correlation(name).alias("reference"), text.digest(F.col("props")).alias("digest"))


_T = "token\\s*=\\s*\"[0-9a-f]{40}\""


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_T}', 'token = \"[REDACTED_SECRET]\"', 'g'), 'sk-[A-Za-z0-9_-]{{20,}}', '[REDACTED_SECRET]', 'g') AS text FROM documents")
def secret_tokens_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@query(f"SELECT doc_id, 'secret-assignment' AS kind, 'redacted' AS disposition, 'token' AS name, CAST(NULL AS VARCHAR) AS reason FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_T}')) FROM documents)")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "findings")
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.kind", "f.disposition", "f.name", "f.reason")


@query(f"""
SELECT 'raw' AS "column", count(*) AS leaks FROM documents WHERE regexp_matches(text, '{_T}') HAVING count(*) > 0
UNION ALL SELECT 'note', count(*) FROM documents WHERE doc_id % 10 = 3 HAVING count(*) > 0
""")
def final_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three columns, one is redacted, one isn't, and one has a planted key in every tenth row."""
    note = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("key sk-"), F.repeat(F.lit("a"), 24))).otherwise("sk-short")
    docs = table(spark, sf_dir, "documents").select("text", F.col("text").alias("raw"), note.alias("note"))
    return redaction.leaks(redaction.redacted(docs, ["text"]), ["text", "raw", "note"])


# tool names with the kind that the published table gives each
_TOOLS = {
    "Bash": "shell", "run_terminal_cmd": "shell", "commandExecution": "shell", "KillShell": "shell", "Read": "read", "NotebookRead": "read", "cat": "read", "apply_patch": "edit",
    "MultiEdit": "edit", "fileChange": "edit", "Grep": "search", "list_dir": "search", "WebFetch": "web", "browse": "web", "Task": "delegate", "spawn_agent": "delegate",
    "TodoWrite": "plan", "update_plan": "plan", "bashful": "other", "reader": "other", "": "other",
}


def _values(rows) -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join(f"({k}, {', '.join(map(quoted, row))})" for k, row in enumerate(rows))


@query(f"""
SELECT v.name, v.kind AS tool_kind, count(*) AS n FROM events e JOIN (VALUES {_values(_TOOLS.items())}) v(k, name, kind) ON e.event_id % {len(_TOOLS)} = v.k GROUP BY ALL
""")
def tool_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("event_id") % len(_TOOLS) + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(name.alias("name"), commands.tool_kind(name).alias("tool_kind")).agg(F.count("*").alias("n"))


# commands with the checks that they run, the source paths that they write, their heads and their first checks
_COMMANDS = [
    ("pnpm run test && pnpm lint", "test,lint", "", "pnpm run test", "test"),
    ("cd /w && sed -i s/a/b/ src/app/main.ts", "", "src/app/main.ts", "sed", "inspect"),
    ("bash -lc 'npx tsc --noEmit | tail'", "typecheck", "", "npx tsc", "typecheck"),
    ("git status", "", "", "git status", "vcs"),
    ("CI=1 timeout 60 yarn --cwd web jest --listTests", "", "", "yarn jest", "other"),
    ("npx playwright install chromium", "", "", "npx playwright", "other"),
    ("cargo test --all", "test", "", "cargo test", "test"),
    ("python3 -m pytest -q tests", "test", "", "python3 -m pytest", "test"),
    ("for f in a b; do wc -l $f; done", "", "", "for-block", "other"),
    ("pip install -r requirements.txt", "", "", "pip install", "install"),
    ("npm install", "", "", "npm install", "install"),
    ("rm -rf src/old.ts node_modules/x.js && cp a.md docs/b.md", "", "src/old.ts,docs/b.md", "rm", "other"),
    ("echo x > out/report.json 2> err.log", "", "out/report.json", "echo x >", "inspect"),
    ("ruff check . ; mypy src", "lint,typecheck", "", "ruff check", "lint"),
    ("corepack pnpm build", "", "", "corepack pnpm", "other"),
    ("pnpm --filter web exec vitest run", "test", "", "pnpm exec vitest", "test"),
    ("prettier --write src/a.ts", "format", "", "prettier", "format"),
    ("", "", "", "", "other"),
]


@query(f"""
SELECT e.event_id, v.checks, v.writes, v.head_of, v.primary_check FROM events e
JOIN (VALUES {_values(_COMMANDS)}) v(k, command, checks, writes, head_of, primary_check) ON e.event_id % {len(_COMMANDS)} = v.k
""")
def command_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = commands.udfs(spark)
    forms = F.array(*(F.lit(c) for c, *_ in _COMMANDS))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(forms, (F.col("event_id") % len(_COMMANDS) + 1).cast("int")).alias("c"))
    return rows.select("event_id", F.array_join(f["check_kinds"]("c"), ",").alias("checks"), F.array_join(f["shell_writes"]("c"), ",").alias("writes"), f["command_head"]("c").alias("head_of"), f["primary_check"]("c").alias("primary_check"))


# what a turn says after its text, and the claim that is in it
_SAID = [("All tests passed", "All tests passed", "test"), ("The tests were not run yet", "", ""), ("Everything is green", "", ""), ("- lint is clean", "lint is clean", "lint")]


@query(f"""
SELECT c.conv_id, c.turn, v.claim, v.kinds FROM conversations c JOIN (VALUES {_values(_SAID)}) v(k, said, claim, kinds) ON (c.conv_id + c.turn) % {len(_SAID)} = v.k
WHERE c.role = 'assistant' AND v.claim <> ''
""")
def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(x) for x, *_ in _SAID)), ((F.col("conv_id") + F.col("turn")) % len(_SAID) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(text.claim_lines(F.concat(F.col("text"), F.lit("\n"), said))).alias("c"))
    return rows.select("conv_id", "turn", F.col("c.text").alias("claim"), F.array_join("c.kinds", ",").alias("kinds"))
