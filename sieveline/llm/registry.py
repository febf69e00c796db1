"""The corpus operators' queries and SQL, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import clustering, decontaminate, fill_middle, language_id, media, mixing, near_dup, packing, secrets, substring_dedup, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filter.op1,
    "op2_media_columns": media.op2,
    "op3_language_id": language_id.op3,
    "op4_secret_scans": secrets.op4,
    "op5_toxicity": toxicity.op5,
    "op6_token_counts": token_counts.op6,
    "op7_ngram_jaccard_join": near_dup.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_benchmark_decontamination": decontaminate.op9,
    "op10_mixing": mixing.op10,
    "op11_fill_in_middle": fill_middle.op11,
    "op12_centroid_clustering": clustering.op12,
    "op13_packing": packing.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op7_ngram_jaccard_join": near_dup.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op12_centroid_clustering": clustering.OP12_SQL,
}
