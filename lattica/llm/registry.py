"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, lm_score, mixing, neardup, quality, shards, suffix_dedup, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_shards": shards.op5_shards,
        "op6_mix": mixing.op6_mix,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality": quality.op8_quality,
        "op9_near_duplicates": neardup.op9_near_duplicates,
        "op10_language": langid.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op1_suffix_dedup": suffix_dedup, "op2_decontaminate": decontaminate, "op5_shards": shards, "op6_mix": mixing, "op8_quality": quality, "op9_near_duplicates": neardup}
    return {name: module.SQL for name, module in found.items()}
