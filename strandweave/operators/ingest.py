"""Spans, buffers, the ledger, extraction payloads and their resolution to entities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.axes import AXES

CHARS_PER_TOKEN = 4
JOINT = "\n\n"


def span_hash(doc: Column, section: Column, text: Column) -> Column:
    z = F.unhex(F.lit("00"))
    b = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    return F.sha2(F.concat(b(doc), z, b(section), z, b(text)), 256)


def token_estimate(text: Column) -> Column:
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / CHARS_PER_TOKEN).cast("int")))


def source_id(arg: Column) -> Column:
    """A literal source id stays; a folder's is made from its path."""
    return F.when(F.startswith(arg, F.lit("src_")), arg).otherwise(F.concat(F.lit("src_"), F.left(F.sha2(arg, 256), F.lit(32))))


def pack(spans: DataFrame, max_tokens: int = 1200, overlap_tokens: int = 100) -> DataFrame:
    """spans(doc_id, section_path, span_no, text, hash) -> doc_id, section_path, buffer_no, text, span_hashes.

    A section of a document is one run of spans and lies in one task, as each buffer depends on the one before it.
    A section's spans are packed in order up to max_tokens; a full buffer leaves its last characters and last hash to the next; a
    span is never split. Rows are sorted within partitions and folded as a stream: the state of one
    buffer is all that is held, whatever a document's size."""
    tail_chars = overlap_tokens * CHARS_PER_TOKEN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, no, text, hashes, tokens = None, 0, [], [], 0

        def made():
            return (*key, no, JOINT.join(text), list(hashes))

        for x in batches:
            out = []
            for d, s, t, h in zip(x["doc_id"], x["section_path"], x["text"], x["hash"]):
                if (d, s) != key:
                    if text:
                        out.append(made())
                    key, no, text, hashes, tokens = (d, s), 1, [], [], 0
                n = max(1, len(t) // CHARS_PER_TOKEN)
                if text and tokens + n > max_tokens:
                    out.append(made())
                    tail = JOINT.join(text)[-tail_chars:] if tail_chars else ""
                    no, text, hashes = no + 1, [tail] if tail else [], hashes[-1:] if tail else []
                    tokens = max(1, len(tail) // CHARS_PER_TOKEN) if tail else 0
                text.append(t)
                hashes.append(h)
                tokens += n
            yield pd.DataFrame(out, columns=["doc_id", "section_path", "buffer_no", "text", "span_hashes"])
        if text:
            yield pd.DataFrame([made()], columns=["doc_id", "section_path", "buffer_no", "text", "span_hashes"])

    s = spans.where("text IS NOT NULL AND text <> ''").select("doc_id", F.coalesce("section_path", F.lit("")).alias("section_path"), "span_no", "text", "hash")
    placed = s.repartition("doc_id", "section_path").sortWithinPartitions("doc_id", "section_path", "span_no")
    return placed.select("doc_id", "section_path", "text", "hash").mapInPandas(run, "doc_id string, section_path string, buffer_no int, text string, span_hashes array<string>")


def not_in_ledger(buffers: DataFrame, ledger: DataFrame, key: str = "buffer_id") -> DataFrame:
    """Buffers that have no hashes, or at least one that the ledger lacks."""
    asked = buffers.select(key, F.explode("span_hashes").alias("h")).select(key, F.coalesce(F.lower("h"), F.lit("")).alias("h"))
    missing = asked.join(ledger.select(F.lower("span_hash").alias("h")), "h", "left_anti").select(key).distinct()
    empty = buffers.where(F.coalesce(F.size("span_hashes"), F.lit(0)) <= 0).select(key)
    return buffers.join(missing.unionByName(empty).distinct(), key, "left_semi")


def ledger_insert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that the ledger lacks, one per hash."""
    return new.where("span_hash IS NOT NULL").dropDuplicates(["span_hash"]).join(ledger.select("span_hash"), "span_hash", "left_anti")


def strip_fence(s: Column) -> Column:
    """One leading ``` line with its language tag, and a trailing ```."""
    t = F.trim(s, F.lit(" \t\r\n"))
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"(?s)\s*```\s*$", "")
    return F.when(F.startswith(t, F.lit("```")), body).otherwise(t)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def payload_error(payload: Column) -> Column:
    """Why an extraction payload is refused; null if it is valid. Types are those of the JSON, not coerced ones."""

    def let(c, f):
        return F.element_at(F.transform(F.array(c), f), 1)

    def get(v, k):
        return F.when(_kind(v) == "OBJECT", F.try_variant_get(v, f"$.{k}", "variant"))

    def has(v, k):
        return F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), k)

    def items(v):
        return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))

    def first(errors):
        return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))

    def triple(t):
        conf = F.try_variant_get(t, "$.confidence", "double")
        gone = F.when(has(t, "subject") & has(t, "predicate") & has(t, "object") & has(t, "ontology_axis") & has(t, "confidence"), F.lit(None)).otherwise("triple lacks a key")
        return (
            F.when(F.coalesce(_kind(t) != "OBJECT", F.lit(True)), "triple is not an object")
            .when(gone.isNotNull(), gone)
            .when(F.coalesce(~F.try_variant_get(t, "$.ontology_axis", "string").isin(*AXES), F.lit(True)) | (_kind(get(t, "ontology_axis")) != "STRING"), "unknown axis")
            .when(~_kind(get(t, "confidence")).isin(*_NUMBERS), "confidence is not a number")
            .when(~conf.between(0.0, 1.0), "confidence is out of range")
        )

    def proposition(p):
        text = get(p, "text")
        return (
            F.when(F.coalesce(_kind(p) != "OBJECT", F.lit(True)), "proposition is not an object")
            .when(~has(p, "text") | ~has(p, "triples"), "proposition lacks a key")
            .when((_kind(text) != "STRING") | (F.trim(F.try_variant_get(p, "$.text", "string")) == ""), "text is blank or no string")
            .when(_kind(get(p, "triples")) != "ARRAY", "triples is no list")
            .otherwise(first(F.transform(items(get(p, "triples")), triple)))
        )

    def whole(v):
        return (
            F.when(F.coalesce(_kind(v) != "OBJECT", F.lit(True)), "payload is not an object")
            .when(~has(v, "propositions"), "payload lacks propositions")
            .when(_kind(get(v, "propositions")) != "ARRAY", "propositions is no list")
            .otherwise(first(F.transform(items(get(v, "propositions")), proposition)))
        )

    def parsed(s):
        closed = F.endswith(s, F.lit("}")) | F.endswith(s, F.lit("]")) | F.endswith(s, F.lit('"')) | s.rlike("[A-Za-z0-9]$")
        return F.when(closed, F.try_parse_json(s))

    return let(strip_fence(payload), lambda s: let(parsed(s), lambda v: F.when(v.isNull(), "no valid JSON").otherwise(whole(v))))


def triples(units: DataFrame) -> DataFrame:
    """unit_id, source_id, doc_id, section_path, received_at, prop_no, triple_no and the triple's fields, one row per id and position."""
    p = units.select("unit_id", "source_id", "doc_id", "section_path", "received_at", F.posexplode("propositions").alias("i", "p"))
    t = p.where("p IS NOT NULL").select("unit_id", "source_id", "doc_id", "section_path", "received_at", (F.col("i") + 1).alias("prop_no"), F.col("p.text").alias("text"), F.posexplode("p.triples").alias("j", "t"))
    return t.where("t IS NOT NULL").select("unit_id", "source_id", "doc_id", "section_path", "received_at", "prop_no", "text", (F.col("j") + 1).alias("triple_no"), "t.*").dropDuplicates(["unit_id", "prop_no", "triple_no"])


def proposition_id(source: Column, doc: Column, section: Column, text: Column, no: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in (source, doc, section, text)], no.cast("string")))


def surfaces(t: DataFrame) -> DataFrame:
    """unit_id, surface, first_pos (prop_no, triple_no, side: 0 subject, 1 object): each unit's distinct entity spellings, by first appearance."""
    said = lambda c, side: F.struct(F.col(c).alias("surface"), F.struct("prop_no", "triple_no", F.lit(side).alias("side")).alias("p"))
    s = t.select("unit_id", F.explode(F.array(said("subject", 0), said("object", 1))).alias("x"))
    return s.where("x.surface IS NOT NULL").groupBy("unit_id", F.col("x.surface").alias("surface")).agg(F.min("x.p").alias("first_pos"))


def resolve(t: DataFrame, entity: DataFrame) -> DataFrame:
    """Triples with the ids of their subject and object, found by lower-cased name; an unknown name gives null."""
    by = entity.where("name IS NOT NULL").groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("eid"))
    s = t.join(by.select(F.col("key").alias("sk"), F.col("eid").alias("src_id")), F.lower("subject") == F.col("sk"), "left").drop("sk")
    return s.join(by.select(F.col("key").alias("ok"), F.col("eid").alias("dst_id")), F.lower("object") == F.col("ok"), "left").drop("ok")
