"""JSON lines out: finetuning examples and failure records; the evaluation suite in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUITE = "id string, question string, gold_answer string, gold_doc_ids array<string>, hops int, negative_control boolean"


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> int:
    """One JSON object a line; returns how many. A single file is for small exports only: it passes one task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.text(path).count()


def append_failures(df: DataFrame, path: str) -> None:
    """doc_id, section_path, error_type, error_message -> appended with a time."""
    df.select(F.current_timestamp().alias("timestamp"), "doc_id", "section_path", "error_type", "error_message").write.mode("append").json(path)


def read_suite(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """An evaluation suite; blank lines are skipped; a limit of None or 0 means all."""
    s = spark.read.schema(SUITE).json(path).where("id IS NOT NULL")
    return s.limit(limit) if limit else s
