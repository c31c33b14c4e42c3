"""Reading the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_id(c: Column | str) -> Column:
    """A reference to a hex id: letter case and hyphens carry no meaning."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.replace(c, F.lit("-"), F.lit("")))
