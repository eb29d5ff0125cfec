"""The queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from undertow.llm import attention_lm, decontaminate, html_text, language_id, mixing, near_dedup, prefix_trie, quality_rules, runs, secrets, sharding, token_counts, url_filter
from undertow.llm.oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm_language": lambda s, d: language_id.language_query(table(s, d, "documents")),
    "op2_odd_sketches": lambda s, d: near_dedup.dedup_query(table(s, d, "documents")),
    "op3_quality_rules": lambda s, d: quality_rules.quality_query(table(s, d, "documents"), table(s, d, "labels")),
    "op5_pareto_mix": lambda s, d: mixing.mixing_query(table(s, d, "documents")),
    "op4_attention_lm": lambda s, d: attention_lm.lm_query(table(s, d, "documents")),
    "op6_edit_tokens": lambda s, d: token_counts.token_query(table(s, d, "documents")),
    "op7_assignment_secrets": lambda s, d: secrets.scan_secrets(table(s, d, "documents")),
    "op8_suffix_arrays": lambda s, d: decontaminate.decontamination_query(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_bloom_urls": lambda s, d: url_filter.url_query(table(s, d, "pages")),
    "op10_hash_ring": lambda s, d: sharding.sharding_query(table(s, d, "documents")),
    "op11_html_clusters": lambda s, d: html_text.html_query(table(s, d, "pages")),
    "op12_time_forward_trie": lambda s, d: prefix_trie.trie_query(table(s, d, "conversations")),
    "op13_periodic_runs": lambda s, d: runs.runs_query(table(s, d, "documents")),
}
