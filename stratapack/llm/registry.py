"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, lm_scoring, media, mixing, pieces, quality_model, quality_rules, sharding, simhash, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.query,
    "op2_language_id": language_id.query,
    "op3_quality_model": quality_model.query,
    "op4_media": media.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_sharding": sharding.query,
    "op7_quality_rules": quality_rules.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_pieces": pieces.query,
    "op10_mixing": mixing.query,
}

ORACLES: dict[str, str] = {
    "op6_sharding": sharding.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
