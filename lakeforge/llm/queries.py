"""The queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_spotsigs, op2_personal_data, op3_lm_scoring, op4_sentencepiece, op5_substring_dedup
from . import op6_quality_rules, op7_quality_classifier, op8_mixing, op9_sharding, op10_near_duplicates
from . import op11_cross_tokenizer, op12_merkle_manifest, op13_nearest_neighbours


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spotsigs": op1_spotsigs.query,
        "op2_personal_data": op2_personal_data.query,
        "op3_lm_scoring": op3_lm_scoring.query,
        "op4_sentencepiece": op4_sentencepiece.query,
        "op5_substring_dedup": op5_substring_dedup.query,
        "op6_quality_rules": op6_quality_rules.query,
        "op7_quality_classifier": op7_quality_classifier.query,
        "op8_mixing": op8_mixing.query,
        "op9_sharding": op9_sharding.query,
        "op10_near_duplicates": op10_near_duplicates.query,
        "op11_cross_tokenizer": op11_cross_tokenizer.query,
        "op12_merkle_manifest": op12_merkle_manifest.query,
        "op13_nearest_neighbours": op13_nearest_neighbours.query,
    }


def oracle_sql() -> dict[str, str]:
    """For the others, the learnt or hashed part is beyond SQL, or too slow there on whole tables; tests/llm holds
    them against brute force, exact round trips and held-out accuracy."""
    return {"op12_merkle_manifest": op12_merkle_manifest.ORACLE_SQL}
