"""Extraction units: typed rows and raw JSON payloads brought to one nested schema.

A payload counts once code fences, string quoting and single outer objects are taken off, up to eight layers of text and four of objects. What is then not one complete JSON
object gives no row (broken or cut JSON, null, a list, a duplicate key, text behind the object). A single object in
place of a list is a list of one; null elements keep their position; an element that is neither null nor an object keeps its place with
null fields (a proposition keeps a string as its text); any other value in place of a list is no list. Keys may come in any order, be
absent or extra. Null payloads give no row, and extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE_FIELDS = {"subject": "string", "predicate": "string", "object": "string", "ontology_axis": "string", "confidence": "double"}
TRIPLE_DDL = "struct<subject:string,predicate:string,object:string,ontology_axis:string,confidence:double>"
PROPOSITIONS_DDL = f"array<struct<text:string,triples:array<{TRIPLE_DDL}>>>"
_FENCE = r"(?s)^\s*```[^\n`{\[]*\n?(.*?)\s*```\s*$"
LAYERS, OBJECTS = 8, 4


def _let(c: Column, f) -> Column:
    """f of c, with c evaluated once: a lambda's variable isn't inlined by the optimiser."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID ... of a variant; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _unquote(s: Column) -> Column:
    quoted = F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))
    return F.when(quoted, F.coalesce(F.try_variant_get(F.try_parse_json(s), "$", "string"), s)).otherwise(s)


def _unfence(s: Column) -> Column:
    """One fence off; what has none only loses the blanks around it."""
    return _let(F.trim(s, F.lit(" \t\r\n\ufeff")), lambda x: F.when(F.startswith(x, F.lit("```")), F.trim(F.regexp_replace(x, _FENCE, "$1"), F.lit(" \t\r\n\ufeff"))).otherwise(x))


def _unwrap(v: Column) -> Column:
    """The inner object where an object has just one key, and that isn't the unit's own list."""

    def inner(keys: Column) -> Column:
        first = F.get(F.map_values(keys), F.lit(0))
        return F.when((F.size(keys) == 1) & ~F.array_contains(F.map_keys(keys), "propositions") & (_kind(first) == "OBJECT"), first).otherwise(v)

    return F.coalesce(_let(F.try_variant_get(v, "$", "map<string,variant>"), inner), v)


def parse_payload(df: DataFrame, payload: str) -> DataFrame:
    """Adds `__v`: the payload's object as a variant, wrapping taken off; null where there is none."""
    s = _unfence(F.col(payload))
    for _ in range(LAYERS):  # each pass takes one layer of quoting off, and a fence within
        s = _let(s, lambda x: F.when(F.startswith(x, F.lit("{")), x).otherwise(_unfence(_unquote(x))))
    whole = _let(s, lambda x: F.when(F.startswith(x, F.lit("{")) & F.endswith(x, F.lit("}")), F.try_parse_json(x)))
    for _ in range(OBJECTS):
        whole = _let(whole, _unwrap)
    return df.withColumn("__v", whole)


def _as_list(v: Column) -> Column:
    return _let(v, lambda x: F.when(_kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")).when(_kind(x) == "OBJECT", F.array(x)))


def _null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _field(v: Column, name: str, to: str) -> Column:
    return F.when(_kind(v) == "OBJECT", F.try_variant_get(v, f"$.{name}", to))


def _triple(v: Column) -> Column:
    return F.when(~_null(v), F.struct(*[_field(v, n, t).alias(n) for n, t in TRIPLE_FIELDS.items()]))


def _proposition(v: Column) -> Column:
    text = F.coalesce(_field(v, "text", "string"), F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")))
    triples = F.transform(_as_list(_field(v, "triples", "variant")), _triple)
    return F.when(~_null(v), F.struct(text.alias("text"), triples.alias("triples")))


def units_from_payloads(raw: DataFrame) -> DataFrame:
    """raw_unit rows -> unit_id, source_id, doc_id, section_path, span_hashes, propositions, received_at."""
    v = F.col("__v")
    return (
        parse_payload(raw, "payload")
        .where(v.isNotNull())
        .select(
            "unit_id",
            "source_id",
            F.try_variant_get(v, "$.doc_id", "string").alias("doc_id"),
            F.try_variant_get(v, "$.section_path", "string").alias("section_path"),
            F.try_variant_get(v, "$.span_hashes", "array<string>").alias("span_hashes"),
            F.transform(_as_list(F.try_variant_get(v, "$.propositions", "variant")), _proposition).cast(PROPOSITIONS_DDL).alias("propositions"),
            "received_at",
        )
    )


def all_units(ingest_unit: DataFrame, raw_unit: DataFrame) -> DataFrame:
    """Both unit tables in one nested schema."""
    cols = ["unit_id", "source_id", "doc_id", "section_path", "span_hashes", "propositions", "received_at"]
    return ingest_unit.select(*cols[:5], F.col("propositions").cast(PROPOSITIONS_DDL).alias("propositions"), "received_at").unionByName(units_from_payloads(raw_unit).select(*cols))
