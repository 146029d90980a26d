"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("personal_data", stages.personal_data),
    ("mixture", stages.mixture),
    ("tokens", stages.tokens),
]
#: None: the stages' near duplicates, trees and tokens cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``; each one's result is written and read again."""
    return stages.run(STAGES, spark, sf_dir)
