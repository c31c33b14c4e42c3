"""Queries for the training-data problems, and the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import format_dupes, incremental, leakage, mixture, neighbours, truncation
from strandweave.sources.tables import ref_id, table


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Entity names, and predicates between the same two entities, as rows(tbl, src, dst, id, text)."""
    none = F.lit("")
    ent = table(spark, d, "entity").select(F.lit("entity").alias("tbl"), none.alias("src"), none.alias("dst"), "id", F.col("name").alias("text"))
    rel = table(spark, d, "rel").select(F.lit("rel").alias("tbl"), ref_id("src_id").alias("src"), ref_id("dst_id").alias("dst"), "id", F.col("predicate").alias("text"))
    return ent.unionByName(rel.where("src IS NOT NULL AND dst IS NOT NULL"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dupes.format_duplicates(_names(spark, d), ["tbl", "src", "dst"]).select("tbl", "keep_id", "dup_id")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return format_dupes.format_records(_names(spark, d), ["tbl", "src", "dst"]).select("tbl", "keep_id", "base", "quals", "n_rows", "n_spellings", "n_ids")


def _vectors(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n).select("id", "embedding") for n in ("entity", "proposition")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d), min_similarity=0.85)


def every_hundredth(i: Column) -> Column:
    """Whether a hex id is divisible by 100 (2^64 leaves 16); others are not."""
    h = F.lpad(F.lower(F.replace(i, F.lit("-"), F.lit(""))), 32, "0")
    part = lambda a: F.conv(F.substring(h, a, 16), 16, 10).cast("decimal(20,0)") % 100
    return h.rlike("^[0-9a-f]{32}$") & ((part(1) * 16 + part(17)) % 100 == 0)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of all rows for every row whose id is divisible by 100, however weak the similarity."""
    n = neighbours.neighbours(_vectors(spark, d), asks=every_hundredth, **neighbours.THOROUGH)
    return n.select("tbl", neighbours.unpack_id(F.col("id")).alias("id"), neighbours.unpack_id(F.col("neighbour")).alias("neighbour_id"), F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.link_batches(table(spark, d, "span"), table(spark, d, "buffer"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), ["question", "gold_answer"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("n_edits = 0").select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many pages."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_pages"), F.min("n_edits").alias("n_edits"))


def _mixed(spark: SparkSession, d: str, size) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_target"), size)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as what the listed sources hold; sources too small for their share fall short."""
    return _mixed(spark, d, mixture.all_tokens)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, reached and lacking shares of that mixture."""
    return mixture.shares_report(_mixed(spark, d, mixture.all_tokens), table(spark, d, "source_target"))


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source that has tokens keeps its share; the scarcest source sets its size."""
    return _mixed(spark, d, mixture.largest_exact)


def p7_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares_report(_mixed(spark, d, mixture.largest_exact), table(spark, d, "source_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents")).where("cut").select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_shares(truncation.judged(table(spark, d, "documents")))


_CANON = r"""
n AS (
  SELECT 'entity' tbl, '' src, '' dst, id, name txt FROM entity
  UNION ALL
  SELECT 'rel', lower(replace(src_id,'-','')), lower(replace(dst_id,'-','')), id, predicate FROM rel WHERE src_id IS NOT NULL AND dst_id IS NOT NULL),
c AS (
  SELECT tbl, src, dst, id, txt,
    lower(regexp_replace(regexp_replace(txt, '[\p{L}\p{N}]+[\s\p{Z}\x{200b}\x{feff}]*[:=][\s\p{Z}\x{200b}\x{feff}]*[\p{L}\p{N}]+', ' ', 'g'), '[^\p{L}\p{N}]+', '', 'g')) base,
    coalesce(array_to_string(list_sort(list_distinct(list_transform(
      regexp_extract_all(txt, '[\p{L}\p{N}]+[\s\p{Z}\x{200b}\x{feff}]*[:=][\s\p{Z}\x{200b}\x{feff}]*[\p{L}\p{N}]+'),
      lambda q: regexp_replace(lower(replace(q, '=', ':')), '[^\p{L}\p{N}:]+', '', 'g')))), ';'), '') quals
  FROM n WHERE txt IS NOT NULL AND id IS NOT NULL),
g AS (
  SELECT tbl, src, dst, base, quals, min(id) keep_id, count(*) n_rows, count(DISTINCT txt) n_spellings, count(DISTINCT id) n_ids
  FROM c GROUP BY 1, 2, 3, 4, 5)
"""
_WORDS12 = r"""
w AS (
  SELECT k, i, unnest(list_transform(range(1, greatest(len(t) - 10, 1)), lambda j: array_to_string(t[j:j + 11], ' '))) g
  FROM (SELECT k, i, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') t FROM
    (SELECT 'd' k, CAST(doc_id AS VARCHAR) i, text x FROM documents
     UNION ALL SELECT 'q', item_id, question FROM eval_item
     UNION ALL SELECT 'q', item_id, gold_answer FROM eval_item)))
"""

# Pages with 12 words of an item, at most one of them replaced, dropped or added: runs of words with one left open meet on the rest.
_ONE_EDIT = r"""
wd AS (SELECT k, i, f, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') t FROM
    (SELECT 'd' k, CAST(doc_id AS VARCHAR) i, '' f, "text" x FROM documents
     UNION ALL SELECT 'q', item_id, 'question', question FROM eval_item
     UNION ALL SELECT 'q', item_id, 'gold_answer', gold_answer FROM eval_item)),
item AS (SELECT DISTINCT i, f, t[j:j + 11] g FROM (SELECT i, f, t, unnest(range(1, len(t) - 10)) j FROM wd WHERE k = 'q' AND len(t) >= 12)),
hit AS (
  SELECT array_to_string(g, ' ') h, i, f, 0 c FROM item
  UNION ALL SELECT array_to_string(g[1:m - 1] || ['*'] || g[m + 1:12], ' '), i, f, 1 FROM item, range(1, 13) r(m)
  UNION ALL SELECT array_to_string(g[1:m - 1] || g[m + 1:12], ' '), i, f, 1 FROM item, range(1, 13) r(m)
  UNION ALL SELECT array_to_string(g[1:m - 1] || ['*'] || g[m:12], ' '), i, f, 1 FROM item, range(2, 13) r(m)),
page AS (SELECT i, t, unnest(range(1, len(t) - 9)) j FROM wd WHERE k = 'd' AND len(t) >= 11),
said AS (
  SELECT i, array_to_string(t[j:j + 10], ' ') h FROM page
  UNION ALL SELECT i, array_to_string(t[j:j + 11], ' ') FROM page WHERE j + 11 <= len(t)
  UNION ALL SELECT i, array_to_string(t[j:j + m - 2] || ['*'] || t[j + m:j + 11], ' ') FROM page, range(1, 13) r(m) WHERE j + 11 <= len(t)
  UNION ALL SELECT i, array_to_string(t[j:j + m - 2] || ['*'] || t[j + m:j + 12], ' ') FROM page, range(2, 13) r(m) WHERE j + 12 <= len(t)),
leak AS (SELECT CAST(said.i AS BIGINT) doc_id, hit.i item_id, hit.f field, CAST(min(hit.c) AS INT) n_edits FROM said JOIN hit ON said.h = hit.h GROUP BY 1, 2, 3)
"""


def _usable_sql(t: str) -> str:
    bad = "list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))"
    return f"SELECT DISTINCT '{t}' tbl, id, CAST(embedding AS DOUBLE[]) v FROM {t} WHERE id IS NOT NULL AND len(embedding) = 64 AND len({bad}) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


# Every pair: what the forest finds is held against it where all pairs can be had.
_NEAREST = f"""
e AS ({_usable_sql('entity')} UNION ALL {_usable_sql('proposition')}),
s AS (SELECT a.tbl, a.id, b.id other, list_cosine_similarity(a.v, b.v) sim FROM e a JOIN e b ON a.tbl = b.tbl AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY tbl, id ORDER BY round(sim, 9) DESC, other) n FROM s WHERE sim >= 0.85)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_nearest, p5_found, p6_found, p6_leaks, p6_items, p7_mixture, p7_shares, p7_exact, p7_exact_shares, p8_found, p8_shares)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_CANON} SELECT DISTINCT c.tbl, keep_id, id dup_id FROM c JOIN g USING (tbl, src, dst, base, quals) WHERE id <> keep_id",
        "p1_records": f"WITH {_CANON} SELECT tbl, keep_id, base, quals, n_rows, n_spellings, n_ids FROM g",
        "p2_found": f"WITH {_NEAREST} SELECT DISTINCT tbl, least(id, other) id_a, greatest(id, other) id_b FROM r WHERE n <= 5",
        "p6_leaks": f"WITH {_ONE_EDIT} SELECT doc_id, item_id, field, n_edits FROM leak",
        "p6_items": f"WITH {_ONE_EDIT} SELECT item_id, count(DISTINCT doc_id) n_pages, min(n_edits) n_edits FROM leak GROUP BY 1",
        "p6_found": f"WITH {_WORDS12} SELECT DISTINCT CAST(a.i AS BIGINT) doc_id, b.i item_id FROM w a JOIN w b ON a.g = b.g WHERE a.k = 'd' AND b.k = 'q'",
    }
