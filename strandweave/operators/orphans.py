"""References to records that do not exist.

Parent and child keys are brought into one long form and grouped once by (parent table, key); that aggregate
combines on the map side, so a key that a third of all rows refer to costs one row per task. Only keys that can be
orphans leave it. Their references are found again by a join that is salted by the referring row.

Cases: null keys and null references are no references; an id with several parent rows is one record, deleted if any
row is deleted and created at its earliest row; repeated child rows are one reference; an empty parent table makes every
reference an orphan; an empty child table gives no row. A reference whose own time is null is an orphan only if its
target is missing or deleted. Other columns of the tables are never read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: name, rows, and expressions for key, deletion mark and creation time."""

    name: str
    df: DataFrame
    key: Column
    deleted_at: Column
    created_at: Column


@dataclass(frozen=True)
class Reference:
    """A referring column: expressions for the row's id, the target key (or an array of keys) and the two times."""

    tbl: str
    field: str
    parent: str
    df: DataFrame
    row_id: Column
    target: Column
    ref_time: Column
    period_time: Column
    many: bool = False


def _children(refs: list[Reference]) -> DataFrame:
    parts = []
    for r in refs:
        d = r.df.select(
            F.lit(r.parent).alias("pt"),
            (F.explode(r.target) if r.many else r.target).alias("key"),
            F.lit(r.tbl).alias("tbl"),
            F.lit(r.field).alias("ref_field"),
            r.row_id.alias("row_id"),
            r.ref_time.alias("ref_time"),
            F.trunc(r.period_time, "month").alias("period"),
        )
        parts.append(d.where(F.col("key").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def suspect_keys(parents: list[Parent], children: DataFrame) -> DataFrame:
    """One row per referred-to key that is missing, deleted, or younger than a reference to it.

    Tagged long form: parents carry flags, children their earliest reference time; one aggregate by (pt, key).
    """
    long = reduce(
        DataFrame.unionByName,
        [
            p.df.select(
                F.lit(p.name).alias("pt"),
                p.key.alias("key"),
                F.lit(1).alias("is_parent"),
                F.when(p.deleted_at.isNotNull(), 1).otherwise(0).alias("dead"),
                p.created_at.alias("born"),
                F.lit(None).cast("timestamp").alias("ref_time"),
            ).where(F.col("key").isNotNull())
            for p in parents
        ]
        + [
            children.select(
                "pt", "key", F.lit(0).alias("is_parent"), F.lit(0).alias("dead"), F.lit(None).cast("timestamp").alias("born"), F.col("ref_time").cast("timestamp")
            )
        ],
    )
    status = long.groupBy("pt", "key").agg(
        F.max("is_parent").alias("found"),
        F.min("is_parent").alias("only_parent"),
        F.max("dead").alias("dead"),
        F.min("born").alias("born"),
        F.min("ref_time").alias("first_ref"),
    )
    gone = (F.col("found") == 0) | (F.col("dead") == 1)
    return status.where((F.col("only_parent") == 0) & (gone | (F.col("born") > F.col("first_ref")))).select("pt", "key", gone.alias("gone"), "born")


def orphans(parents: list[Parent], refs: list[Reference], salts: int = 8) -> DataFrame:
    """(tbl, ref_field, row_id, target_id, period): distinct references that point at no living record."""
    children = _children(refs)
    bad = suspect_keys(parents, children).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = (
        children.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
        .join(bad, ["pt", "key", "salt"])
        .where(F.col("gone") | (F.col("born") > F.col("ref_time")))
    )
    return hit.groupBy("tbl", "ref_field", "row_id", F.col("key").alias("target_id")).agg(F.min("period").alias("period"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month of the referring row."""
    return found.groupBy("tbl", "ref_field", "period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("target_id").alias("n_targets"))
