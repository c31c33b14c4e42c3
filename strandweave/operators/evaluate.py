"""Evaluation of answers: citation precision and recall, recall at k, judge scores, medians by system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed value: what may stand around a score.
AROUND = "[](){}.,;:'\"-"


def leaf(ref: Column) -> Column:
    """Lower-cased last part of a reference's section."""
    section = F.get(F.split(ref, "#", 2), F.lit(1))
    return F.lower(F.trim(F.element_at(F.split(section, "/"), -1)))


def doc(ref: Column) -> Column:
    return F.get(F.split(ref, "#", 2), F.lit(0))


def same_citation(a: Column, b: Column) -> Column:
    both = F.contains(a, F.lit("#")) & F.contains(b, F.lit("#"))
    return (a == b) | (both & (doc(a) == doc(b)) & (leaf(a) == leaf(b)))


def citation_scores(gold: Column, pred: Column) -> tuple[Column, Column]:
    """Precision and recall of two small arrays; nothing cited is precise, nothing to find is found."""
    g, p = F.coalesce(gold, F.array().cast("array<string>")), F.coalesce(pred, F.array().cast("array<string>"))
    hit_p = F.size(F.filter(p, lambda x: F.exists(g, lambda y: same_citation(y, x))))
    hit_g = F.size(F.filter(g, lambda y: F.exists(p, lambda x: same_citation(y, x))))
    precision = F.when(F.size(p) == 0, F.lit(1.0)).when(F.size(g) == 0, F.lit(0.0)).otherwise(hit_p / F.size(p))
    recall = F.when(F.size(g) == 0, F.lit(1.0)).when(F.size(p) == 0, F.lit(0.0)).otherwise(hit_g / F.size(g))
    return precision, recall


def recall_at_k(gold: Column, retrieved: Column, k: int) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.coalesce(F.size(g), F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(g, F.slice(retrieved, 1, k))) / F.size(g))


def judge_score(text: Column) -> Column:
    """The first token that, stripped of brackets and punctuation, is a number from 0 to 4; else 0."""
    tokens = F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.trim(t, F.lit(AROUND)))
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.rlike("^[0-4]$")), F.lit(0)).cast("int"), F.lit(0))


def medians(rows: DataFrame, by: list[str]) -> DataFrame:
    names = ("correctness", "chars_read", "tokens", "citation_precision", "citation_recall")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.median(c).cast("double").alias(f"median_{c}") for c in names])


def means_by_hops(rows: DataFrame) -> DataFrame:
    """Mean correctness per system and hop count, with a total per system (hops null)."""
    return rows.rollup("system", "hops").agg(F.avg("correctness").alias("mean_correctness"), F.count(F.lit(1)).alias("n")).where("system IS NOT NULL")
