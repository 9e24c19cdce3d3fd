"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haze.llm import decontaminate, divergence, language_id, licenses, near_dedup, packing, prefix_trie, quality, substring_dedup, token_file, toxicity, vector_search, wrappers
from haze.llm.common import ship


def _shipped(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {name: _shipped(fn) for name, fn in {
    "op1_decontamination": decontaminate.query,
    "op2_vector_search": vector_search.query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_token_file": token_file.query,
    "op6_language_id": language_id.query,
    "op7_html_wrappers": wrappers.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_near_dedup": near_dedup.query,
    "op10_licenses": licenses.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_quality": quality.query,
    "op13_divergence": divergence.query,
}.items()}

ORACLE = {
    "op1_decontamination": decontaminate.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_quality": quality.SQL,
    "op13_divergence": divergence.SQL,
}
