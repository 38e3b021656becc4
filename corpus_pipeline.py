"""The corpus pipeline: quality rules, exact and near deduplication, mixing, tokens.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again
as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, exact_dedup, mixing, quality, simhash
from tracemill.llm.common import discard, scratch, scratch_scope, table

STAGES = [
    ("quality_rules", quality.filter_stage),
    ("exact_dedup", exact_dedup.dedup_stage),
    ("simhash_near_dedup", simhash.dedup_stage),
    ("pareto_mixing", mixing.mix_stage),
    ("bpe", bpe.encode_stage),
]
#: SQL can't express fingerprints' components nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with scratch_scope(spark):  # what a stage has written on its way goes when its result stands
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
