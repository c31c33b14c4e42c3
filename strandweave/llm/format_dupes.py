"""Problem 1: duplicates hidden by formatting differences.

Byte-identical raw rows are collapsed first, with counts; only the distinct survivors are canonicalised; a second
grouping on the full canonical text sums the counts. Both groupings combine on the map side, so a text that a third of all rows
hold costs one row per task. Members are found again by a join that is salted by the row's id.

Canonical text: the qualifiers (a word, `:` or `=`, a one-word value) are taken out, lower-cased and put in order as a
set; of the rest only letters and digits stay, lower-cased.

Cases: a null text or null id is never a duplicate and gives no record; texts without any letter or digit equal each other if their
qualifiers do (the empty text among them); rows that repeat an id count as copies but are one id; ties for keep_id cannot occur, it is the smallest id; an
empty table gives no row; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}]+"
_GAP = r"[\s\p{Z}\x{200b}\x{feff}]*"
QUALIFIER = f"{_WORD}{_GAP}[:=]{_GAP}{_WORD}"
_NOISE = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> tuple[Column, Column]:
    """(letters and digits of the text without qualifiers, its qualifiers in order, joined by `;`)."""
    quals = F.transform(
        F.regexp_extract_all(text, F.lit(QUALIFIER), F.lit(0)),
        lambda q: F.regexp_replace(F.lower(F.translate(q, "=", ":")), r"[^\p{L}\p{N}:]+", ""),
    )
    base = F.regexp_replace(F.lower(F.regexp_replace(text, QUALIFIER, " ")), _NOISE, "")
    return base, F.array_join(F.array_sort(F.array_distinct(quals)), ";")


def _keyed(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct raw rows with counts and smallest / largest id, and then their canonical form."""
    raw = rows.groupBy(*scope, "text").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    base, quals = canonical(F.col("text"))
    return raw.withColumn("base", base).withColumn("quals", quals)


def format_duplicates(rows: DataFrame, scope: list[str], salts: int = 8) -> DataFrame:
    """rows(id, text, *scope) -> (*scope, keep_id, dup_id): one row for each id of a record but its smallest."""
    rows = rows.where(F.col("text").isNotNull() & F.col("id").isNotNull())
    keyed = _keyed(rows, scope)
    records = keyed.groupBy(*scope, "base", "quals").agg(F.min("lo").alias("keep_id"), F.max("hi").alias("__hi"))
    several = records.where(F.col("keep_id") != F.col("__hi")).drop("__hi")
    spellings = keyed.select(*scope, "text", "base", "quals").join(several, [*scope, "base", "quals"]).select(*scope, "text", "keep_id")
    spread = spellings.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = rows.select(*scope, "text", "id").withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    hit = members.join(spread, [*scope, "text", "__salt"]).where(F.col("id") != F.col("keep_id"))
    return hit.select(*scope, "keep_id", F.col("id").alias("dup_id")).distinct()


def format_records(rows: DataFrame, scope: list[str]) -> DataFrame:
    """rows(id, text, *scope) -> one row per record: canonical text and qualifiers, keep_id, n_rows, n_spellings, n_ids."""
    rows = rows.where(F.col("text").isNotNull() & F.col("id").isNotNull())
    by_id = rows.groupBy(*scope, "text", "id").agg(F.count(F.lit(1)).alias("c"))
    raw = by_id.groupBy(*scope, "text").agg(F.min("id").alias("lo"), F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"))
    base, quals = canonical(F.col("text"))
    return (
        raw.withColumn("base", base)
        .withColumn("quals", quals)
        .groupBy(*scope, "base", "quals")
        .agg(F.min("lo").alias("keep_id"), F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_spellings"), F.sum("n_ids").alias("n_ids"))
    )
