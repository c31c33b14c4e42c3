"""Queries over spans, buffers, the ledger, extraction payloads, upserts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.axes import AXES
from strandweave.config import Config
from strandweave.operators import answer, complete, graph, ingest, vectors
from strandweave.operators.units import units_from_payloads
from strandweave.plans.retrieval import propositions, with_chain
from strandweave.sources import markdown
from strandweave.sources.tables import table

CFG = Config()
LEDGER_UNTIL = 12  # spans of earlier batches count as ledgered


def distinct_spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "span").dropDuplicates(["span_id"])


def _triples(spark: SparkSession, d: str) -> DataFrame:
    t = ingest.triples(table(spark, d, "ingest_unit"))
    return t.withColumn("pid", ingest.proposition_id(F.col("source_id"), F.col("doc_id"), F.col("section_path"), F.col("text"), F.col("prop_no")))


def assertions(spark: SparkSession, d: str) -> DataFrame:
    """Edge assertions in order: (received_at, unit_id, prop_no, triple_no)."""
    t = _triples(spark, d).where("subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL AND confidence BETWEEN 0 AND 1")
    t = t.where(F.col("ontology_axis").isin(*AXES))
    return t.select(
        F.lower("subject").alias("src"), F.lower("object").alias("dst"), "predicate", F.col("ontology_axis").alias("axis"), "confidence", F.col("pid").alias("proposition_id"), "source_id", F.coalesce("received_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "unit_id", "prop_no", "triple_no"
    )


SEQ = ["at", "unit_id", "prop_no", "triple_no"]
EDGE_KEY = ["src", "dst", "predicate"]


def q_span_text(spark: SparkSession, d: str) -> DataFrame:
    return markdown.text_spans(table(spark, d, "documents").where("fmt = 'txt'")).select("doc_id", "section_path", F.length("text").alias("n_chars"), "hash")


def q_span_markdown(spark: SparkSession, d: str) -> DataFrame:
    return markdown.markdown_spans(table(spark, d, "documents").where("fmt = 'md'")).select("doc_id", "span_no", "section_path", "text")


def q_span_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of PDF documents, one span each, named by their page."""
    p = table(spark, d, "documents").where("fmt = 'pdf'").select("doc_path", "section_path", F.trim(F.col("text"), F.lit(" \t\r\n")).alias("text")).where("text <> ''")
    return p.groupBy("doc_path", "section_path").agg(F.min(ingest.span_hash(F.col("doc_path"), F.col("section_path"), F.col("text"))).alias("hash"), F.count(F.lit(1)).alias("n"))


def q_span_hash(spark: SparkSession, d: str) -> DataFrame:
    s = distinct_spans(spark, d)
    h = ingest.span_hash(F.col("doc_id"), F.col("section_path"), F.col("text"))
    return s.select("span_id", h.alias("hash_made"), (h == F.lower("hash")).alias("as_stored"))


def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return distinct_spans(spark, d).select("span_id", ingest.token_estimate(F.col("text")).alias("tokens"))


def q_source_id(spark: SparkSession, d: str) -> DataFrame:
    """Source ids of the documents' folders, and of ids given literally."""
    folders = table(spark, d, "documents").select(F.regexp_extract("doc_path", "^(.*)/", 1).alias("arg"))
    return folders.unionByName(table(spark, d, "entity").select(F.col("source_id").alias("arg"))).where("arg IS NOT NULL").distinct().select("arg", ingest.source_id(F.col("arg")).alias("source_id"))


def _packed(spark: SparkSession, d: str, most: int, overlap: int) -> DataFrame:
    s = distinct_spans(spark, d).select("doc_id", "section_path", F.col("span_id").alias("span_no"), "text", "hash")
    return ingest.pack(s, most, overlap).select("doc_id", "section_path", "buffer_no", F.size("span_hashes").alias("n_spans"), F.length("text").alias("n_chars"))


def q_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Spans packed to buffers as configured."""
    return _packed(spark, d, CFG.ingest.span_max_tokens, CFG.ingest.overlap_tokens)


def q_small_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Spans packed to buffers of 250 tokens with an overlap of 25, so that packing and overflow are both frequent."""
    return _packed(spark, d, 250, 25)


def ledger(spark: SparkSession, d: str) -> DataFrame:
    s = distinct_spans(spark, d).where((F.col("batch_no") < LEDGER_UNTIL) & F.col("hash").isNotNull())
    return s.select(F.lower("hash").alias("span_hash"), "doc_id", "section_path").dropDuplicates(["span_hash"])


def buffers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "buffer").dropDuplicates(["buffer_id"])


def q_ledger_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.not_in_ledger(buffers(spark, d), ledger(spark, d)).select("buffer_id", "batch_no")


def q_ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    old = ledger(spark, d)
    new = distinct_spans(spark, d).select(F.lower("hash").alias("span_hash"), "doc_id", "section_path")
    return old.select("span_hash").unionByName(ingest.ledger_insert(old, new).select("span_hash"))


def q_ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    b, todo = buffers(spark, d), ingest.not_in_ledger(buffers(spark, d), ledger(spark, d)).select("buffer_id", F.lit(1).alias("todo"))
    t = _triples(spark, d)
    one = b.join(todo, "buffer_id", "left").agg(F.count(F.lit(1)).alias("buffers"), F.sum(F.when(F.col("todo").isNull(), 1).otherwise(0)).alias("skipped"))
    two = t.agg(F.countDistinct("unit_id", "prop_no").alias("propositions"), F.count(F.lit(1)).alias("rels"))
    three = ingest.surfaces(t).agg(F.count(F.lit(1)).alias("entities"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # three rows of one


def q_strip_fence(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_unit").dropDuplicates(["unit_id"])
    s = ingest.strip_fence(F.col("payload"))
    return r.select("unit_id", F.length(s).alias("n_chars"), F.md5(s).alias("digest"))


def q_validate(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_unit").dropDuplicates(["unit_id"])
    return r.select("unit_id", F.coalesce(ingest.payload_error(F.col("payload")), F.lit("valid")).alias("verdict"))


def q_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Refused payloads by reason."""
    return q_validate(spark, d).where("verdict <> 'valid'").groupBy(F.col("verdict").alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def q_extract(spark: SparkSession, d: str) -> DataFrame:
    """Propositions and triples that the offline back-end extracts from each buffer, validated."""
    good, _ = complete.extract(buffers(spark, d).select("buffer_id", "text"))
    raw = good.select(F.col("buffer_id").alias("unit_id"), F.lit("s").alias("source_id"), "payload", F.lit(None).cast("timestamp").alias("received_at"))
    p = F.col("propositions")
    return units_from_payloads(raw).select(F.col("unit_id").alias("buffer_id"), F.size(p).alias("n_propositions"), F.size(F.flatten(F.transform(p, lambda x: x["triples"]))).alias("n_triples"))


def q_entity_surface(spark: SparkSession, d: str) -> DataFrame:
    return ingest.surfaces(_triples(spark, d)).select("unit_id", "surface", "first_pos.prop_no", "first_pos.triple_no", "first_pos.side")


def q_triple_resolve(spark: SparkSession, d: str) -> DataFrame:
    t = ingest.resolve(_triples(spark, d), graph.live(table(spark, d, "entity")))
    return t.select("unit_id", "prop_no", "triple_no", "src_id", "dst_id")


def q_prop_insert(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "ingest_unit").dropDuplicates(["unit_id"]).select("unit_id", "source_id", "doc_id", "section_path", F.posexplode("propositions").alias("i", "p")).where("p IS NOT NULL")
    no = (F.col("i") + 1).cast("int")
    return u.select("unit_id", no.alias("prop_no"), ingest.proposition_id(F.col("source_id"), F.col("doc_id"), F.col("section_path"), F.col("p.text"), no).alias("pid"))


def q_entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    m = t.join(ingest.surfaces(t).withColumnRenamed("surface", "name"), "unit_id").select("unit_id", "name", "source_id", F.coalesce("received_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "first_pos").distinct()
    return graph.upsert_entities(m, ["at", "unit_id", "first_pos"]).select("id", "name", "mention_count", "source_id")


def q_base_weight(spark: SparkSession, d: str) -> DataFrame:
    return assertions(spark, d).select("unit_id", "prop_no", "triple_no", F.round(graph.base_weight(F.col("confidence")) + 1e-9, 6).alias("base_weight"))


def q_rel_weight(spark: SparkSession, d: str) -> DataFrame:
    """The weight fold on a coarse key, with long chains."""
    a = assertions(spark, d).withColumn("b", graph.base_weight(F.col("confidence")))
    return graph.fold_weight(a, ["predicate"], SEQ, "b").select("predicate", F.round(F.col("base_weight") + 1e-9, 6).alias("base_weight"))


def q_rel_axis(spark: SparkSession, d: str) -> DataFrame:
    return graph.vote_axis(assertions(spark, d), ["predicate"], SEQ, "axis").select("predicate", "axis", F.element_at("axis_counts", F.col("axis")).alias("votes"))


def q_rel_support(spark: SparkSession, d: str) -> DataFrame:
    return graph.keep_support(assertions(spark, d), ["predicate"], SEQ, "proposition_id").select("predicate", F.size("support").alias("n"), F.md5(F.array_join("support", ",")).alias("digest"))


def q_rel_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = graph.upsert_edges(assertions(spark, d), EDGE_KEY, SEQ)
    return e.select(*EDGE_KEY, "n_assertions", "source_id", F.round(F.col("base_weight") + 1e-9, 6).alias("base_weight"), "axis", F.array_join("support", ",").alias("support"))


def q_prop_edges(spark: SparkSession, d: str) -> DataFrame:
    return answer.supporting_edges(propositions(spark, d), graph.edge_rows(table(spark, d, "rel"))).select("id", F.col("n_edges").cast("int").alias("n_edges"))


def q_export_finetune(spark: SparkSession, d: str) -> DataFrame:
    x = answer.training_examples(answer.supporting_edges(propositions(spark, d), graph.edge_rows(table(spark, d, "rel"))))
    return x.select("id", "source", "source_id", "prompt", "completion", F.array_join("axes", ",").alias("axes"), F.array_join("predicates", "|").alias("predicates"))


def q_word_count(spark: SparkSession, d: str) -> DataFrame:
    return propositions(spark, d).select("id", answer.word_count(F.col("text")).alias("words"))


def q_dimension_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either vector table whose embedding cannot be used, by why."""
    out = None
    for t in ("entity", "proposition"):
        e = F.col("embedding")
        why = F.when(e.isNull(), "null").when(F.size(e) != 64, "size").when(~vectors.usable("embedding"), "numbers").otherwise("usable")
        x = table(spark, d, t).groupBy(F.lit(t).alias("tbl"), why.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


_QUERIES = (
    q_span_text, q_span_markdown, q_span_pages, q_span_hash, q_token_estimate, q_source_id, q_buffers, q_small_buffers, q_ledger_filter, q_ledger_merge, q_ingest_stats, q_strip_fence, q_validate, q_quarantine, q_extract, q_entity_surface,
    q_triple_resolve, q_prop_insert, q_entity_upsert, q_base_weight, q_rel_weight, q_rel_axis, q_rel_support, q_rel_upsert, q_prop_edges, q_export_finetune, q_word_count, q_dimension_guard,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_SPAN = "sp1 AS MATERIALIZED (SELECT span_id, any_value(doc_id) doc_id, any_value(section_path) section_path, any_value(text) AS \"text\", any_value(hash) hash, any_value(batch_no) batch_no FROM span GROUP BY span_id)"
_LEDGER = _SPAN + f", led AS MATERIALIZED (SELECT DISTINCT lower(hash) h FROM sp1 WHERE batch_no < {LEDGER_UNTIL} AND hash IS NOT NULL), buf AS MATERIALIZED (SELECT buffer_id, any_value(span_hashes) hs, any_value(batch_no) batch_no FROM buffer GROUP BY 1), todo AS MATERIALIZED (SELECT buffer_id, batch_no FROM buf WHERE coalesce(len(hs), 0) = 0 OR EXISTS (SELECT 1 FROM (SELECT unnest(hs) x) WHERE x IS NULL OR lower(x) NOT IN (SELECT h FROM led)))"
_TRI = """u1 AS MATERIALIZED (SELECT unit_id, any_value(doc_id) doc_id, any_value(section_path) section_path, any_value(source_id) source_id, any_value(propositions) ps, any_value(received_at) received_at FROM ingest_unit WHERE unit_id IS NOT NULL GROUP BY 1),
pr AS MATERIALIZED (SELECT * FROM (SELECT unit_id, doc_id, section_path, source_id, received_at, i prop_no, ps[i] p FROM (SELECT *, unnest(range(1, len(ps) + 1)) i FROM u1)) WHERE p IS NOT NULL),
pid AS MATERIALIZED (SELECT *, md5(concat_ws(chr(31), coalesce(source_id, ''), coalesce(doc_id, ''), coalesce(section_path, ''), coalesce(p.text, ''), CAST(prop_no AS VARCHAR))) pid FROM pr),
tr AS MATERIALIZED (SELECT unit_id, doc_id, section_path, source_id, received_at, prop_no, pid, j triple_no, t.subject subject, t.predicate predicate, t."object" obj, t.ontology_axis axis, t.confidence confidence
  FROM (SELECT *, p.triples[j] t FROM (SELECT *, unnest(range(1, len(p.triples) + 1)) j FROM pid)) WHERE t IS NOT NULL),
asr AS MATERIALIZED (SELECT lower(subject) src, lower(obj) dst, predicate, axis, confidence, pid, source_id, coalesce(received_at, TIMESTAMP '1970-01-01') ats, unit_id, prop_no, triple_no, least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * confidence) b
  FROM tr WHERE subject IS NOT NULL AND obj IS NOT NULL AND predicate IS NOT NULL AND confidence BETWEEN 0 AND 1 AND axis IN ('causal', 'taxonomic', 'temporal', 'definitional', 'exemplification'))"""
_SURF = _TRI + """, surf AS MATERIALIZED (SELECT unit_id, surface, min(pos) first_pos FROM (SELECT unit_id, subject surface, struct_pack(p := prop_no, t := triple_no, k := 0) pos FROM tr UNION ALL SELECT unit_id, obj, struct_pack(p := prop_no, t := triple_no, k := 1) FROM tr) WHERE surface IS NOT NULL GROUP BY 1, 2)"""


def _fold(key: str) -> str:
    """The folds as window SQL over all assertions of a key."""
    o = "ats, unit_id, prop_no, triple_no"
    return f"""{_TRI}, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {o}) i, count(*) OVER (PARTITION BY {key}) n FROM asr),
w AS MATERIALIZED (SELECT {key}, sum(b * power(0.5::DOUBLE, n - i + CASE WHEN i > 1 THEN 1 ELSE 0 END)) base_weight, max(n) n_assertions, arg_max(source_id, i) source_id FROM seq GROUP BY {key}),
cnt AS MATERIALIZED (SELECT {key}, axis, count(*) c, min(i) f, max(i) l FROM seq GROUP BY {key}, axis),
vote AS MATERIALIZED (SELECT {key}, axis, c FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN c = mc AND l = ml THEN 0 ELSE 1 END, c DESC, f) r FROM (SELECT *, max(c) OVER (PARTITION BY {key}) mc, max(l) OVER (PARTITION BY {key}) ml FROM cnt)) WHERE r = 1),
sup AS MATERIALIZED (SELECT {key}, count(*) cn, string_agg(pid, ',' ORDER BY f) support FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY f DESC) r FROM (SELECT {key}, pid, min(i) f FROM seq GROUP BY {key}, pid)) WHERE r <= 100 GROUP BY {key})"""


def _first_error(v: str, path: str, x: str, case: str) -> str:
    return f"list_filter(list_transform(json_extract({v}, '{path}[*]'), lambda {x}: {case}), lambda y: y IS NOT NULL)[1]"


_AXIS_LIST = ", ".join(f"'{a}'" for a in AXES)
_TRIPLE_ERROR = f"""CASE WHEN json_type(t) <> 'OBJECT' THEN 'triple is not an object'
  WHEN NOT list_has_all(json_keys(t), ['subject', 'predicate', 'object', 'ontology_axis', 'confidence']) THEN 'triple lacks a key'
  WHEN json_type(t, '$.ontology_axis') <> 'VARCHAR' OR t->>'$.ontology_axis' NOT IN ({_AXIS_LIST}) THEN 'unknown axis'
  WHEN json_type(t, '$.confidence') NOT IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'confidence is not a number'
  WHEN CAST(t->>'$.confidence' AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'confidence is out of range' END"""
_PROPOSITION_ERROR = f"""CASE WHEN json_type(p) <> 'OBJECT' THEN 'proposition is not an object'
  WHEN NOT list_has_all(json_keys(p), ['text', 'triples']) THEN 'proposition lacks a key'
  WHEN json_type(p, '$.text') <> 'VARCHAR' OR trim(p->>'$.text') = '' THEN 'text is blank or no string'
  WHEN json_type(p, '$.triples') <> 'ARRAY' THEN 'triples is no list' ELSE {_first_error('p', '$.triples', 't', _TRIPLE_ERROR)} END"""
_VERDICT = rf"""WITH f AS (SELECT unit_id, trim(any_value(payload), chr(32) || chr(9) || chr(13) || chr(10)) t FROM raw_unit GROUP BY 1),
s AS (SELECT unit_id, CASE WHEN t LIKE '```%' THEN regexp_replace(regexp_replace(t, '^```[^\n]*\n', ''), '\s*```\s*$', '') ELSE t END s FROM f),
j AS (SELECT unit_id, CASE WHEN regexp_matches(s, '[}}\]"A-Za-z0-9]$') AND json_valid(s) THEN CAST(s AS JSON) END v FROM s),
w AS (SELECT unit_id, coalesce(CASE WHEN v IS NULL THEN 'no valid JSON' WHEN json_type(v) <> 'OBJECT' THEN 'payload is not an object'
  WHEN NOT list_contains(json_keys(v), 'propositions') THEN 'payload lacks propositions' WHEN json_type(v, '$.propositions') <> 'ARRAY' THEN 'propositions is no list'
  ELSE {_first_error('v', '$.propositions', 'p', _PROPOSITION_ERROR)} END, 'valid') verdict FROM j)
"""


def oracle_sql() -> dict[str, str]:
    def pack(most: int, overlap: int) -> str:
        tail, over = 4 * overlap, f"f.tok + s.t > {most}"
        return f"""WITH RECURSIVE {_SPAN}, s AS MATERIALIZED (SELECT doc_id, coalesce(section_path, '') section_path, length("text") n, greatest(1, length("text") // 4) t, row_number() OVER (PARTITION BY doc_id, coalesce(section_path, '') ORDER BY span_id) i FROM sp1 WHERE "text" IS NOT NULL AND "text" <> ''),
      f AS (SELECT doc_id, section_path, i, 1 b, t tok, n len, 1 c FROM s WHERE i = 1
        UNION ALL SELECT s.doc_id, s.section_path, s.i, CASE WHEN {over} THEN f.b + 1 ELSE f.b END,
          CASE WHEN {over} THEN greatest(1, least({tail}, f.len) // 4) + s.t ELSE f.tok + s.t END,
          CASE WHEN {over} THEN least({tail}, f.len) + 2 + s.n ELSE f.len + 2 + s.n END, CASE WHEN {over} THEN 2 ELSE f.c + 1 END
        FROM f JOIN s ON s.doc_id = f.doc_id AND s.section_path = f.section_path AND s.i = f.i + 1)
      SELECT doc_id, section_path, CAST(b AS INT) buffer_no, CAST(max(c) AS INT) n_spans, CAST(max(len) AS INT) n_chars FROM f GROUP BY 1, 2, 3"""

    edges = """sup AS MATERIALIZED (SELECT DISTINCT pid, src, dst, predicate, axis, id eid FROM (SELECT id, src, dst, predicate, axis, unnest(support) pid FROM edge)),
    by_ AS MATERIALIZED (SELECT pid, count(*) n, arg_min(predicate, struct_pack(src := src, dst := dst, p := predicate, e := eid)) FILTER (WHERE predicate <> '') said, string_agg(DISTINCT axis, ',' ORDER BY axis) FILTER (WHERE axis <> '') axes, string_agg(DISTINCT predicate, '|' ORDER BY predicate) FILTER (WHERE predicate <> '') predicates FROM sup GROUP BY 1)"""
    return {
        "q_span_text": """SELECT CAST(doc_id AS VARCHAR) doc_id, '' section_path, CAST(length(t) AS INT) n_chars, sha256(CAST(doc_id AS VARCHAR) || chr(0) || chr(0) || t) hash FROM (SELECT doc_id, trim("text", chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) t FROM documents WHERE fmt = 'txt') WHERE t <> ''""",
        "q_span_pages": """SELECT doc_path, section_path, min(sha256(coalesce(doc_path, '') || chr(0) || coalesce(section_path, '') || chr(0) || t)) hash, count(*) n FROM (SELECT doc_path, section_path, trim("text", chr(32) || chr(9) || chr(13) || chr(10)) t FROM documents WHERE fmt = 'pdf') WHERE t <> '' GROUP BY 1, 2""",
        "q_span_hash": f"""WITH {_SPAN} SELECT span_id, h hash_made, h = lower(hash) as_stored FROM (SELECT *, sha256(coalesce(doc_id, '') || chr(0) || coalesce(section_path, '') || chr(0) || coalesce("text", '')) h FROM sp1)""",
        "q_token_estimate": f"""WITH {_SPAN} SELECT span_id, CAST(CASE WHEN coalesce(length("text"), 0) = 0 THEN 0 ELSE greatest(1, length("text") // 4) END AS INT) tokens FROM sp1""",
        "q_source_id": "SELECT arg, CASE WHEN arg LIKE 'src\\_%' ESCAPE '\\' THEN arg ELSE 'src_' || substr(sha256(arg), 1, 32) END source_id FROM (SELECT DISTINCT arg FROM (SELECT regexp_extract(doc_path, '^(.*)/', 1) arg FROM documents UNION ALL SELECT source_id FROM entity) WHERE arg IS NOT NULL)",
        "q_buffers": pack(CFG.ingest.span_max_tokens, CFG.ingest.overlap_tokens),
        "q_small_buffers": pack(250, 25),
        "q_ledger_filter": f"WITH {_LEDGER} SELECT buffer_id, batch_no FROM todo",
        "q_ledger_merge": f"WITH {_SPAN} SELECT DISTINCT lower(hash) span_hash FROM sp1 WHERE hash IS NOT NULL",
        "q_ingest_stats": f"WITH {_LEDGER}, {_SURF} SELECT (SELECT count(*) FROM buf) buffers, (SELECT count(*) FROM buf) - (SELECT count(*) FROM todo) skipped, (SELECT count(DISTINCT (unit_id, prop_no)) FROM tr) propositions, (SELECT count(*) FROM tr) rels, (SELECT count(*) FROM surf) entities",
        "q_validate": _VERDICT + "SELECT unit_id, verdict FROM w",
        "q_quarantine": _VERDICT + "SELECT verdict error_type, count(*) n FROM w WHERE verdict <> 'valid' GROUP BY 1",
        "q_extract": r"""WITH b AS (SELECT buffer_id, trim(any_value("text"), chr(32) || chr(9) || chr(13) || chr(10)) t FROM buffer WHERE "text" IS NOT NULL GROUP BY 1),
    s AS (SELECT buffer_id, list_filter(string_split(regexp_replace(t, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}_]+')) >= 3) s FROM b)
    SELECT buffer_id, CAST(len(s) AS INT) n_propositions, CAST(len(s) AS INT) n_triples FROM s""",
        "q_strip_fence": """SELECT unit_id, CAST(length(s) AS INT) n_chars, md5(s) digest FROM (SELECT unit_id, CASE WHEN t LIKE '```%' THEN regexp_replace(regexp_replace(t, '^```[^\\n]*\\n', ''), '\\s*```\\s*$', '') ELSE t END s FROM (SELECT unit_id, trim(any_value(payload), chr(32) || chr(9) || chr(13) || chr(10)) t FROM raw_unit GROUP BY 1))""",
        "q_entity_surface": f"WITH {_SURF} SELECT unit_id, surface, CAST(first_pos.p AS INT) prop_no, CAST(first_pos.t AS INT) triple_no, first_pos.k side FROM surf",
        "q_triple_resolve": with_chain("ent", "SELECT 1").replace("\nSELECT 1", f""", {_TRI}, nm AS MATERIALIZED (SELECT lower(name) k, min(id) id FROM ent WHERE name IS NOT NULL GROUP BY 1)
      SELECT t.unit_id, CAST(t.prop_no AS INT) prop_no, CAST(t.triple_no AS INT) triple_no, a.id src_id, b.id dst_id FROM tr t LEFT JOIN nm a ON a.k = lower(t.subject) LEFT JOIN nm b ON b.k = lower(t.obj)"""),
        "q_prop_insert": f"WITH {_TRI} SELECT unit_id, CAST(prop_no AS INT) prop_no, pid FROM pid",
        "q_entity_upsert": f"""WITH {_SURF}, m AS (SELECT s.surface, s.unit_id, s.first_pos, u.source_id, coalesce(u.received_at, TIMESTAMP '1970-01-01') ats FROM surf s JOIN u1 u USING (unit_id))
      SELECT md5(lower(surface)) id, arg_min(surface, struct_pack(a := ats, u := unit_id, p := first_pos)) "name", count(*) - 1 mention_count, arg_max(source_id, struct_pack(a := ats, u := unit_id, p := first_pos)) source_id FROM m GROUP BY lower(surface)""",
        "q_base_weight": f"WITH {_TRI} SELECT unit_id, CAST(prop_no AS INT) prop_no, CAST(triple_no AS INT) triple_no, round(b + 1e-9, 6) base_weight FROM asr",
        "q_rel_weight": f"WITH {_fold('predicate')} SELECT predicate, round(base_weight + 1e-9, 6) base_weight FROM w",
        "q_rel_axis": f"WITH {_fold('predicate')} SELECT predicate, axis, CAST(c AS INT) votes FROM vote",
        "q_rel_support": f"WITH {_fold('predicate')} SELECT predicate, CAST(cn AS INT) n, md5(support) digest FROM sup",
        "q_rel_upsert": f"WITH {_fold('src, dst, predicate')} SELECT w.src, w.dst, w.predicate, w.n_assertions, w.source_id, round(w.base_weight + 1e-9, 6) base_weight, v.axis, s.support FROM w JOIN vote v USING (src, dst, predicate) JOIN sup s USING (src, dst, predicate)",
        "q_prop_edges": with_chain("edge", "SELECT 1").replace("\nSELECT 1", f",\n{edges}\nSELECT p.id, CAST(coalesce(b.n, 0) AS INT) n_edges FROM prop p LEFT JOIN by_ b ON b.pid = p.id"),
        "q_export_finetune": with_chain("edge", "SELECT 1").replace(
            "\nSELECT 1",
            f""",\n{edges}\nSELECT p.id, coalesce(p.source_doc, '') || '#' || coalesce(p.source_span, '') source, coalesce(p.source_id, 'default') source_id,
      coalesce('Answer this question grounded in the corpus: What does the corpus say about ' || b.said || '?', 'State the fact: ' || rtrim(substr(coalesce(p.text, ''), 1, 60), '.') || CASE WHEN length(p.text) > 60 THEN '...' ELSE '' END) prompt,
      coalesce(p.text, '') completion, coalesce(b.axes, '') axes, coalesce(b.predicates, '') predicates FROM prop p LEFT JOIN by_ b ON b.pid = p.id""",
        ),
        "q_word_count": with_chain("prop", r"SELECT id, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS INT) words FROM prop"),
        "q_dimension_guard": " UNION ALL ".join(
            f"SELECT '{t}' tbl, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'size' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'numbers' ELSE 'usable' END verdict, count(*) n FROM {t} GROUP BY 2"
            for t in ("entity", "proposition")
        ),
    }
