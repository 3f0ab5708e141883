"""The corpus pipeline: filter, deduplicate, decontaminate, redact and encode ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldwright.llm import stages

STAGES = stages.STAGES

#: SQL can't express the trained filter of the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each one's result written and read again."""
    return stages.run(spark, sf_dir)
