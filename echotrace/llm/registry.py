"""The queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, cdc_dedup, decontaminate, language_id, line_dedup, minhash, quality, sentencepiece_codec, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_minhash_classes": minhash.op2_minhash_classes,
    "op3_language_mixture": language_id.op3_language_mixture,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_token_histogram": token_counts.op5_token_histogram,
    "op6_line_runs": line_dedup.op6_line_runs,
    "op7_ivf_pq_neighbours": ann.op7_ivf_pq_neighbours,
    "op8_quality_attention": quality.op8_quality_attention,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_cdc_substring_dedup": cdc_dedup.op10_cdc_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_classes": minhash.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op6_line_runs": line_dedup.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
}
