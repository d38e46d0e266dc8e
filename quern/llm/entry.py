"""Queries of this package and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from quern.llm import decontamination, fill_in_middle, jaccard_join, line_dedup, lm_scoring, mixing, quality_rules, quotation, secret_scan, sentencepiece_codec, sharding, structure_repair, substring_dedup

QUERIES = {
    "op1_quotation_linking": quotation.op1_quotation_linking,
    "op2_sharding": sharding.op2_sharding,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_structure_repair": structure_repair.op11_structure_repair,
    "op12_sentencepiece": sentencepiece_codec.op12_sentencepiece,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op8_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_structure_repair": structure_repair.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
