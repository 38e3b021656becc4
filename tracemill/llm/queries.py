"""The operators' queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from tracemill.llm import (
    binary_tokens,
    bpe,
    exact_dedup,
    html_extract,
    mixing,
    quality,
    sentencepiece_bpe,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_simhash_bk_trees": simhash.op3_simhash_bk_trees,
    "op4_bit_packed_tokens": binary_tokens.op4_bit_packed_tokens,
    "op5_bpe": bpe.op5_bpe,
    "op6_pareto_mixing": mixing.op6_pareto_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_permutation_table": sharding.op9_permutation_table,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_sentencepiece": sentencepiece_bpe.op12_sentencepiece,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op6_pareto_mixing": mixing.ORACLE_SQL,
    "op9_permutation_table": sharding.oracle_sql(),
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
