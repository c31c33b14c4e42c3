"""Queries of the general problems: nested records (3) and references to records that do not exist (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.nested import shred
from strandweave.operators.orphans import Parent, Reference, orphan_counts, orphans
from strandweave.operators.units import LAYERS, OBJECTS, TRIPLE_FIELDS, all_units
from strandweave.session import materialise
from strandweave.sources.tables import ref_id, table

UNIT_TABLE, PROPOSITION_TABLE, TRIPLE_TABLE = "unit", "unit__propositions", "unit__propositions__triples"


def unit_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Payloads are parsed once; the tables are cut from what that gave."""
    return shred(materialise(all_units(table(spark, d, "ingest_unit"), table(spark, d, "raw_unit")), "units"), "unit_id", "unit")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = unit_tables(spark, d)
    no = lambda c, n: F.col(c).cast("int").alias(n)
    zero = lambda n: F.lit(0).cast("int").alias(n)
    return (
        t[TRIPLE_TABLE]
        .select("unit_id", no("pos_1", "prop_no"), no("pos_2", "triple_no"))
        .unionByName(t[PROPOSITION_TABLE].where("n_triples = 0").select("unit_id", no("pos_1", "prop_no"), zero("triple_no")))
        .unionByName(t[UNIT_TABLE].where("n_propositions = 0").select("unit_id", zero("prop_no"), zero("triple_no")))
    )


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return unit_tables(spark, d)[UNIT_TABLE]


def p3_propositions(spark: SparkSession, d: str) -> DataFrame:
    return unit_tables(spark, d)[PROPOSITION_TABLE].withColumnRenamed("pos_1", "prop_no")


def p3_triples(spark: SparkSession, d: str) -> DataFrame:
    return unit_tables(spark, d)[TRIPLE_TABLE].withColumnsRenamed({"pos_1": "prop_no", "pos_2": "triple_no"})


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rel, men = table(spark, d, "rel"), table(spark, d, "mentions")
    parents = [Parent(n, table(spark, d, n), ref_id("id"), F.col("deleted_at"), F.col("created_at")) for n in ("entity", "proposition")]
    made = F.col("created_at")
    return orphans(
        parents,
        [
            Reference("rel", "src_id", "entity", rel, F.col("id"), ref_id("src_id"), made, made),
            Reference("rel", "support_propositions", "proposition", rel, F.col("id"), F.transform("support_propositions", ref_id), F.col("last_seen_at"), made, many=True),
            Reference("mentions", "proposition_id", "proposition", men, F.col("mention_id"), ref_id("proposition_id"), made, made),
        ],
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tbl", "ref_field", "row_id", "target_id")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM"))


_P4_SQL = """
WITH parent AS (
  SELECT 'entity' pt, lower(replace(id,'-','')) k, max(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END) dead, min(created_at) born FROM entity GROUP BY 1, 2
  UNION ALL
  SELECT 'proposition', lower(replace(id,'-','')), max(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END), min(created_at) FROM proposition GROUP BY 1, 2),
refs AS (
  SELECT 'entity' pt, 'rel' tbl, 'src_id' ref_field, id row_id, lower(replace(src_id,'-','')) k, created_at rt, created_at pd FROM rel
  UNION ALL
  SELECT 'proposition', 'rel', 'support_propositions', id, lower(replace(u.x,'-','')), last_seen_at, created_at FROM rel, unnest(support_propositions) u(x)
  UNION ALL
  SELECT 'proposition', 'mentions', 'proposition_id', mention_id, lower(replace(proposition_id,'-','')), created_at, created_at FROM mentions),
bad AS (
  SELECT r.tbl, r.ref_field, r.row_id, r.k target_id, min(date_trunc('month', r.pd)) pd
  FROM refs r LEFT JOIN parent p ON p.pt = r.pt AND p.k = r.k
  WHERE r.k IS NOT NULL AND (p.k IS NULL OR p.dead = 1 OR p.born > r.rt) GROUP BY 1, 2, 3, 4)
"""

_BLANK = "' ' || chr(9) || chr(13) || chr(10) || chr(65279)"


def _unfenced(s: str) -> str:
    t = f"trim({s}, {_BLANK})"
    return rf"CASE WHEN starts_with({t}, '```') THEN trim(regexp_replace({t}, '^\s*```[^\n`{{\[]*\n?(.*?)\s*```\s*$', '\1', 's'), {_BLANK}) ELSE {t} END"


def _listed(v: str, path: str) -> str:
    """A list's elements as JSON; an object is a list of one, anything else none."""
    return f"CASE json_type({v}, '{path}') WHEN 'ARRAY' THEN json_extract({v}, '{path}[*]') WHEN 'OBJECT' THEN [json_extract({v}, '{path}')] END"


def _count(elements: str) -> str:
    return f"CAST(coalesce(len(list_filter({elements}, lambda x: json_type(x) <> 'NULL')), 0) AS INT)"


_UNQUOTED = """CASE WHEN starts_with(s, '"') AND ends_with(s, '"') AND json_valid(s) THEN coalesce(json_extract_string(s, '$'), s) ELSE s END"""
_P3_SQL = f"""
WITH RECURSIVE peel AS (
  SELECT DISTINCT unit_id, source_id, received_at, 0 n, {_unfenced('payload')} s FROM raw_unit WHERE payload IS NOT NULL
  UNION ALL
  SELECT unit_id, source_id, received_at, n + 1, {_unfenced(_UNQUOTED)} FROM peel WHERE n < {LAYERS} AND NOT starts_with(s, '{{')),
opened AS (
  SELECT unit_id, source_id, received_at, 0 n, CAST(s AS JSON) v FROM peel WHERE starts_with(s, '{{') AND ends_with(s, '}}') AND json_valid(s)
  UNION ALL
  SELECT unit_id, source_id, received_at, n + 1, json_extract(v, '$.*')[1] FROM opened
  WHERE n < {OBJECTS} AND len(json_keys(v)) = 1 AND json_keys(v)[1] <> 'propositions' AND json_type(json_extract(v, '$.*')[1]) = 'OBJECT'),
sent AS (SELECT unit_id, source_id, received_at, arg_max(v, n) v FROM opened GROUP BY 1, 2, 3),
u AS (
  SELECT unit_id, source_id, v->>'$.doc_id' doc_id, v->>'$.section_path' section_path, received_at,
    CASE WHEN json_type(v, '$.span_hashes') = 'ARRAY' THEN {_count("json_extract(v, '$.span_hashes[*]')")} ELSE 0 END n_span_hashes, {_listed('v', '$.propositions')} ps FROM sent
  UNION ALL
  SELECT DISTINCT unit_id, source_id, doc_id, section_path, received_at, CAST(coalesce(len(list_filter(span_hashes, lambda x: x IS NOT NULL)), 0) AS INT), json_extract(to_json(propositions), '$[*]') FROM ingest_unit),
p AS (
  SELECT unit_id, CAST(prop_no AS INT) prop_no, CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.text' WHEN 'VARCHAR' THEN e->>'$' END txt, CASE WHEN json_type(e) = 'OBJECT' THEN {_listed('e', '$.triples')} END ts
  FROM (SELECT unit_id, unnest(ps) e, unnest(range(1, len(ps) + 1)) prop_no FROM u) WHERE json_type(e) <> 'NULL'),
t AS (
  SELECT unit_id, prop_no, CAST(triple_no AS INT) triple_no, CASE WHEN json_type(e) = 'OBJECT' THEN e END e
  FROM (SELECT unit_id, prop_no, unnest(ts) e, unnest(range(1, len(ts) + 1)) triple_no FROM p) WHERE json_type(e) <> 'NULL')
"""


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_units, p3_propositions, p3_triples, p4_found, p4_counts)}


def oracle_sql() -> dict[str, str]:
    fields = ", ".join(f"TRY_CAST(e->>'$.{n}' AS DOUBLE) {n}" if k == "double" else f"e->>'$.{n}' AS {n}" for n, k in TRIPLE_FIELDS.items())
    return {
        "p3_found": _P3_SQL + f"SELECT unit_id, prop_no, triple_no FROM t UNION ALL SELECT unit_id, prop_no, 0 FROM p WHERE {_count('ts')} = 0 UNION ALL SELECT unit_id, 0, 0 FROM u WHERE {_count('ps')} = 0",
        "p3_units": _P3_SQL + f"SELECT unit_id, source_id, doc_id, section_path, received_at, n_span_hashes, {_count('ps')} n_propositions FROM u",
        "p3_propositions": _P3_SQL + f"SELECT unit_id, prop_no, 'unit' parent_table, txt AS \"text\", {_count('ts')} n_triples FROM p",
        "p3_triples": _P3_SQL + f"SELECT unit_id, prop_no, triple_no, 'unit__propositions' parent_table, {fields} FROM t",
        "p4_found": _P4_SQL + "SELECT tbl, ref_field, row_id, target_id FROM bad",
        "p4_counts": _P4_SQL
        + "SELECT tbl, ref_field, strftime(pd, '%Y-%m') period, count(*) n_orphans, count(DISTINCT target_id) n_targets FROM bad GROUP BY 1, 2, 3",
    }
