"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chunk_store, jaccard_join, license_scan, line_dedup, mixing, nbest, quality, separator_scan, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_quantisation_knn": ann.op1_additive_quantisation_knn,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_chunk_store": chunk_store.op4_chunk_store,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_token_counts": separator_scan.op7_token_counts,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_nbest_encode": nbest.op9_nbest_encode,
    "op10_mix_sources": mixing.op10_mix_sources,
}
SQL: dict[str, str] = {"op2_line_dedup": line_dedup.SQL, "op3_substring_dedup": substring_dedup.SQL, "op5_license_scan": license_scan.SQL, "op6_quality_rules": quality.SQL, "op8_jaccard_join": jaccard_join.SQL}
