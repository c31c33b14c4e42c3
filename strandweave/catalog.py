"""All queries of the core, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.plans import evaluation, ingestion, problems, retrieval

_MODULES = (retrieval, ingestion, evaluation, problems)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q_picked"](spark, sf_dir)
