"""The corpus pipeline: language, quality, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from delimir.llm import stages

STAGES = [
    ("language", stages.language),
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("personal_data", stages.personal_data),
    ("packing", stages.packing),
]

#: Trained models, randomised buckets and packing have no SQL form; tests hold run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    return stages.run(spark, sf_dir, STAGES)
