"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canonry.llm import decontam, exact_dedup, html_extract, langid, ngram_join, packing, sharding, substring_dedup, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": langid.query,
        "op2_toxicity": toxicity.query,
        "op3_decontaminate": decontam.query,
        "op4_ngram_join": ngram_join.query,
        "op5_token_file": token_file.query,
        "op6_pack": packing.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_shard": sharding.query,
        "op9_html_extract": html_extract.query,
        "op10_exact_dedup": exact_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": ngram_join.SQL, "op8_shard": sharding.sql(), "op10_exact_dedup": exact_dedup.SQL}
