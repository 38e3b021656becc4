"""A judge's answers about conversations, made of the turns' own texts and sizes, and where they break the agreed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import answers
from tracemill.plans.registry import query
from tracemill.sources.tables import table


@query(f"""
WITH a AS (SELECT conv_id, turn, text, length(text) AS n, conv_id || '-' || turn AS answer_id FROM conversations WHERE role = 'assistant' AND length(text) > 0),
p AS (SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 4)
SELECT answer_id, 'answer' AS place, 'not-json' AS problem FROM a WHERE n % 13 = 0
UNION ALL SELECT answer_id, 'answer', 'fields-differ' FROM a WHERE n % 13 = 1
UNION ALL SELECT answer_id, 'assessment', 'doesn''t fit the disposition' FROM a WHERE n % 13 > 1 AND n % 3 = 0 AND n % 2 = 0
UNION ALL SELECT answer_id, 'confidence', 'doesn''t fit the disposition' FROM a WHERE n % 13 > 1 AND n % 3 > 0 AND n % 120 > 100
UNION ALL SELECT answer_id, 'missingEvidenceCapability', 'doesn''t fit the disposition' FROM a WHERE n % 13 > 1 AND n % 3 = 0 AND n % 4 = 1
UNION ALL SELECT answer_id, 'rationale', 'no text of that length' FROM a WHERE n % 13 > 1 AND (length(trim(text, ' ')) = 0 OR n > {answers.TEXT})
UNION ALL SELECT answer_id, 'claims', 'no list of that length' FROM a WHERE n % 13 > 1 AND n % 3 > 0 AND n % 17 = 0
UNION ALL SELECT answer_id, 'claims[0]', 'no list of that length' FROM a WHERE n % 13 > 1 AND n % 17 = 5
UNION ALL SELECT answer_id, 'citations[0]', 'outside of the packet' FROM a WHERE n % 13 > 1 AND NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = a.conv_id AND p.turn = a.turn)
UNION ALL SELECT answer_id, 'citations[1]', 'fields-differ' FROM a WHERE n % 13 > 1 AND n % 7 = 0
UNION ALL SELECT answer_id, 'citations[1]', 'outside of the packet' FROM a WHERE n % 13 > 1 AND n % 7 > 0 AND NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = a.conv_id AND p.turn = CASE WHEN n % 11 = 0 THEN a.turn ELSE a.turn - 1 END)
UNION ALL SELECT answer_id, 'citations[1]', 'cited more than once' FROM a WHERE n % 13 > 1 AND n % 7 > 0 AND n % 11 = 0
UNION ALL SELECT answer_id, 'claims[0].citations[0]', 'outside of the packet' FROM a WHERE n % 13 > 1 AND n % 17 NOT IN (0, 5) AND NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = a.conv_id AND p.turn = a.turn)
""")
def judge_answer_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    n, turn = F.length("text"), F.col("turn")
    event = lambda t: F.concat(F.lit("t"), t.cast("string"))
    cite = lambda t: F.struct(event(t).alias("eventId"), F.struct(F.lit("session").alias("artifactId"), F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("line:"), t.cast("string"))).alias("recordLocator")).alias("nativeReference"))
    sound = F.struct(event(turn).alias("eventId"), F.struct(F.lit("session").alias("artifactId"), F.lit("line:1").alias("recordLocator")).alias("nativeReference"))
    assessed = n % 3 > 0
    claim = F.struct(F.lit("one").alias("id"), F.lit("a claim").alias("text"), F.when(n % 17 == 5, F.array().cast(f"array<{_KIND}>")).otherwise(F.array(sound)).alias("citations"), F.lit(None).cast("string").alias("workspace"))
    judgment = F.struct(
        F.when(assessed, "assessed").otherwise("abstained").alias("disposition"),
        F.when(assessed | (n % 2 == 0), "mixed").alias("assessment"),
        F.when(assessed, F.struct((n % 120 / 100).alias("value"), F.lit(answers.SCALE).alias("scale"))).alias("confidence"),
        F.when(~assessed, "no evidence").alias("reason"),
        F.when(~assessed & (n % 4 == 1), "family:unheard").when(~assessed & (n % 4 == 2), "evidence:content").alias("missingEvidenceCapability"),
        F.col("text").alias("rationale"),
        F.lit("another").alias("alternativeExplanation"),
        F.array(sound, cite(F.when(n % 11 == 0, turn).otherwise(turn - 1))).alias("citations"),
        F.when(n % 17 == 0, F.array().cast(f"array<struct<id: string, text: string, citations: array<{_KIND}>, workspace: string>>")).otherwise(F.array(claim)).alias("claims"),
    )
    options = {"ignoreNullFields": "false"}
    doc = F.to_json(F.struct(judgment.alias("judgment")), options)
    doc = F.when(n % 13 == 0, F.concat(doc, F.lit("}"))).when(n % 13 == 1, F.to_json(F.struct(judgment.dropFields("claims").alias("judgment")), options)).otherwise(doc)
    given = turns.where("role = 'assistant' AND length(text) > 0").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("answer_id"), doc.alias("doc"))
    packet = given.select("conv_id", "answer_id").join(turns.where("turn % 5 <> 4").select("conv_id", event(turn).alias("event_id")), "conv_id")
    return answers.answer_breaches(given.select("answer_id", "doc"), packet)


_KIND = "struct<eventId: string, nativeReference: struct<artifactId: string, recordLocator: string>>"
