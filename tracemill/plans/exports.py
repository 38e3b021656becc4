"""Queries of what an export does inside a string, and of the scan behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import exports
from tracemill.plans.registry import query
from tracemill.sources.tables import table

#: Declared strings: so many of the benchmark's longest words are sensitive, with what is left of each without its
#: first or last two letters, so that they overlap; so many more are correlations. The texts are cut at MAX bytes.
DECLARED, MAX = 60, 2500
_WORDS = f"""
words AS (SELECT w, row_number() OVER (ORDER BY length(w) DESC, w) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 10 AND 40),
vals AS (SELECT list(v ORDER BY length(v) DESC, v) AS vs FROM (SELECT DISTINCT unnest([w, substr(w, 3), substr(w, 1, length(w) - 2)]) AS v FROM words WHERE n <= {DECLARED})),
refs AS (SELECT list({{'s': w, 'r': 'ref-' || substr(sha256(w), 1, 20)}} ORDER BY n) AS rs FROM words, vals WHERE n > {DECLARED} AND n <= {2 * DECLARED} AND NOT list_contains(vs, w))
"""
_SECRET = 'token\\s*=\\s*"[0-9a-f]{40}"'
_PATH = "(^|[\\s\"''=:(+\\-])(?:[A-Za-z]:\\\\(?:[^\\\\\\s\"'']+\\\\)*[^\\\\\\s\"'']*|/[^/\\s\"''][^\\s\"'']*)"
_USER = "(?i)((?:user(?:name)?|owner|login)\\s*[:=])\\s*[^\\s,\"''}\\]\\\\]+"


def _declared(spark: SparkSession, sf_dir: str) -> exports.Rules:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    top = [r["w"] for r in words.where(F.length("w").between(10, 40)).orderBy(F.length("w").desc(), "w").limit(2 * DECLARED).collect()]  # the declared strings, a fixed number
    values = {v for w in top[:DECLARED] for v in (w, w[2:], w[:-2])}
    rows = spark.createDataFrame([(w,) for w in top[DECLARED:] if w not in values], "w string")
    refs = {r["w"]: r["r"] for r in rows.select("w", F.concat(F.lit("ref-"), F.substring(F.sha2("w", 256), 1, 20)).alias("r")).collect()}
    return exports.Rules(tuple(values), tuple((w, refs[w]) for w in top[DECLARED:] if w in refs), max_bytes=MAX)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an owner and a path made of their own first words."""
    docs = table(spark, sf_dir, "documents")
    word = lambda k: F.regexp_extract("text", f"^(?:[^a-z]*[a-z]+){{{k}}}[^a-z]*([a-z]+)", 1)
    return docs.select("doc_id", F.concat(F.lit("owner="), word(0), F.lit(" at /"), word(1), F.lit("/"), word(2), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


_CUT = f"""
cut AS (
  SELECT *, hex(encode(t)) AS h FROM u
), ends AS (
  SELECT *, CASE WHEN length(h) <= {2 * MAX} THEN length(h) // 2
                 ELSE {MAX} - list_filter(range(4), lambda k: substr(h, 2 * ({MAX} - k) + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1] END AS n FROM cut
)"""


@query(f"""
WITH {_WORDS},
p AS (
  SELECT doc_id, concat('owner=', regexp_extract(text, '^(?:[^a-z]*[a-z]+){{0}}[^a-z]*([a-z]+)', 1), ' at /', regexp_extract(text, '^(?:[^a-z]*[a-z]+){{1}}[^a-z]*([a-z]+)', 1), '/',
                        regexp_extract(text, '^(?:[^a-z]*[a-z]+){{2}}[^a-z]*([a-z]+)', 1), ' ', coalesce(text, '')) AS t FROM documents
),
v AS (SELECT doc_id, list_reduce(list_prepend(t, vs), lambda a, x: replace(a, x, '[REDACTED_SECRET]')) AS t FROM p, vals),
c AS (SELECT doc_id, t AS before, list_reduce(list_prepend(t, list_transform(rs, lambda x: x.s || '=' || x.r)), lambda a, x: replace(a, split_part(x, '=', 1), split_part(x, '=', 2))) AS t FROM v, refs),
s AS (SELECT doc_id, before, t AS plain, regexp_replace(regexp_replace(t, '{_SECRET}', 'token = "[REDACTED_SECRET]"', 'g'), 'sk-[A-Za-z0-9_-]{{20,}}', '[REDACTED_SECRET]', 'g') AS t FROM c),
l AS (SELECT *, regexp_replace(t, '{_PATH}', '\\1[LOCAL_PATH]', 'g') AS path FROM s),
u AS (SELECT doc_id, before, plain, t AS safe, path, regexp_replace(path, '{_USER}', '\\1[LOCAL_USER]', 'g') AS t FROM l),
{_CUT}
SELECT doc_id, CAST(decode(unhex(substr(h, 1, 2 * n))) AS VARCHAR) AS text,
       CAST(len(regexp_extract_all(safe, '\\[REDACTED_SECRET\\]')) AS BIGINT) AS redacted_secret,
       CAST(len(regexp_extract_all(plain, 'ref-[0-9a-f]{{20}}')) AS BIGINT) AS rewritten_correlation,
       CAST(len(regexp_extract_all(path, '\\[LOCAL_PATH\\]')) + len(regexp_extract_all(t, '\\[LOCAL_USER\\]')) AS BIGINT) AS redacted_local_identifier,
       CAST(2 * n < length(h) AS BIGINT) AS truncated
FROM ends
""")
def export_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exports.rewritten(_payloads(spark, sf_dir), "text", _declared(spark, sf_dir))
    return found.select("doc_id", "text", "actions.*")


def _shapes(text):
    """A record around a turn's text by its length: plain, or JSON of the kinds that harnesses write."""
    record = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    word = F.regexp_extract(text, "([A-Za-z]+)", 1)
    json, lines, plain = "application/json", "application/x-ndjson", "text/plain"
    shapes = [
        (plain, text),
        (json, record(type=F.lit("reasoning"), summary=text)),
        (json, record(payload=record(channel=F.lit("analysis"), text=text))),
        (json, record(thought=F.lit(True), text=text)),
        (json, record(sessionUpdate=F.lit("agent_thought_chunk"), content=text)),
        (json, record(type=F.lit("thinking-text-delta"), delta=text)),
        (json, record(source=F.lit("factory-droid"), signature=text)),
        (json, record(reasoning_content=text)),
        (plain, F.concat(F.lit("user: "), word, F.lit(" "), text)),
        (plain, F.concat(text, F.lit(" /"), word)),
        (lines, F.concat(record(text=text), F.lit("\n"), record(password=text))),
        (json, F.concat(F.lit("{"), text)),
    ]
    pick = lambda k: F.element_at(F.array(*(F.lit(s[k]) if isinstance(s[k], str) else s[k] for s in shapes)), (F.length(text) % len(shapes) + 1).cast("int"))
    return pick(0), pick(1)


@query(f"""
WITH {_WORDS},
t AS (SELECT conv_id, turn, text, length(text) % 12 AS k FROM conversations WHERE text IS NOT NULL),
e AS (
  SELECT conv_id, turn, k, [
    CASE WHEN len(list_filter(vs, lambda x: contains(text, x))) > 0 THEN 'sensitive-value' END,
    CASE WHEN k = 10 THEN 'secret' END, CASE WHEN k = 9 THEN 'local-path' END, CASE WHEN k = 8 THEN 'local-identifier' END,
    CASE WHEN len(list_filter(rs, lambda x: contains(text, x.s))) > 0 THEN 'correlation' END,
    CASE WHEN k = 7 THEN 'hidden-field' END, CASE WHEN k IN (1, 2) THEN 'codex-reasoning' END, CASE WHEN k IN (1, 3, 7) THEN 'pi-reasoning' END,
    CASE WHEN k = 4 THEN 'devin-thought' END, CASE WHEN k IN (5, 6) THEN 'factory-reasoning' END, CASE WHEN k = 11 THEN 'unreadable' END] AS failed
  FROM t, vals, refs
)
SELECT conv_id, turn, array_to_string(list_filter(failed, lambda x: x IS NOT NULL), ' ') AS failed FROM e
""")
def export_final_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    media, record = _shapes(F.col("text"))
    found = exports.scanned(turns.select("conv_id", "turn", record.alias("record"), media.alias("media")), "record", _declared(spark, sf_dir), F.col("media"))
    return found.select("conv_id", "turn", F.array_join("failed", " ").alias("failed"))
