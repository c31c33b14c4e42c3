"""Queries for evaluation, streaming, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import answer, evaluate
from strandweave.plans import ingestion, retrieval
from strandweave.plans.retrieval import with_chain
from strandweave.session import scratch_path
from strandweave.sources.tables import table
from strandweave.streaming import pipelines

SYSTEMS = ("graph", "nearest")


def suite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item").dropDuplicates(["item_id"])


def q_suite_load(spark: SparkSession, d: str) -> DataFrame:
    return suite(spark, d).select("item_id", "question", "gold_answer", "hops", F.size("gold_doc_ids").alias("n_gold"))


def q_bench_grid(spark: SparkSession, d: str) -> DataFrame:
    systems = spark.createDataFrame([(s,) for s in SYSTEMS], "system string")
    return suite(spark, d).select("item_id").crossJoin(F.broadcast(systems))  # two systems


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """system, qid, rank, ref, text: what each system would answer from."""
    cite = F.concat(F.coalesce("source_doc", F.lit("")), F.lit("#"), F.coalesce("source_span", F.lit("")))
    r = retrieval.Retrieval(spark, d)
    full = r.fetched.select(F.lit("graph").alias("system"), "qid", "rank", cite.alias("ref"), "text")
    return full.unionByName(r.nearest(10).select(F.lit("nearest").alias("system"), "qid", "rank", cite.alias("ref"), "text"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One record per system and question. Correctness, 0..4: which fifth the share of the gold answer's words falls into that the evidence
    holds (no model judges here); chars_read: the characters of the evidence. Seconds a question are measured by bench.py and the command line."""
    items = suite(spark, d).select(F.col("item_id").alias("qid"), "gold_doc_ids", "hops", "gold_answer")
    e = evidence(spark, d).groupBy("system", "qid").agg(
        F.array_sort(F.collect_set("ref")).alias("pred"), F.sum(answer.word_count(F.col("text"))).alias("tokens"), F.sum(F.length("text")).alias("chars"),
        F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))).alias("words"),
    )
    p, r = evaluate.citation_scores(F.col("gold_doc_ids"), F.col("pred"))
    gold = F.array_distinct(F.regexp_extract_all(F.lower("gold_answer"), F.lit("[a-z0-9]+"), F.lit(0)))
    share = F.size(F.array_intersect(gold, F.col("words"))) / F.greatest(F.size(gold), F.lit(1))
    return e.join(items, "qid").select("system", "qid", "hops", F.least(F.lit(4), F.floor(share * 5)).cast("int").alias("correctness"), p.alias("citation_precision"), r.alias("citation_recall"), F.col("chars").cast("double").alias("chars_read"), "tokens")


def q_citation_pr(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("system", "qid", F.round("citation_precision", 6).alias("p"), F.round("citation_recall", 6).alias("r"))


def q_citation_match(spark: SparkSession, d: str) -> DataFrame:
    """Gold references that name the same section as a proposition's source, by document and leaf."""
    g = suite(spark, d).select(F.explode("gold_doc_ids").alias("gold")).where("gold IS NOT NULL").distinct()
    ref = F.concat(F.col("source_doc"), F.lit("#"), F.coalesce("source_span", F.lit("")))
    p = table(spark, d, "proposition").where("source_doc IS NOT NULL").select(ref.alias("pred")).distinct()
    hit = g.withColumns({"k1": evaluate.leaf(F.col("gold"))}).join(p.withColumns({"k1": evaluate.leaf(F.col("pred"))}), "k1")
    return hit.groupBy("gold").agg(F.count(F.lit(1)).alias("same_leaf"), F.sum(evaluate.same_citation(F.col("gold"), F.col("pred")).cast("int")).alias("same"))


def q_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """How much of the graph system's evidence is among the five and ten nearest propositions."""
    got = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pid"))), lambda x: x["pid"])
    r = retrieval.Retrieval(spark, d)
    full = r.chosen.groupBy("qid").agg(got.alias("gold"))
    near = r.seed_props.where("rank <= 10").select("qid", F.col("id").alias("pid"), "rank").groupBy("qid").agg(got.alias("near"))
    return full.join(near, "qid").select("qid", F.round(evaluate.recall_at_k(F.col("gold"), F.col("near"), 5), 6).alias("at_5"), F.round(evaluate.recall_at_k(F.col("gold"), F.col("near"), 10), 6).alias("at_10"))


def q_judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Scores read from the propositions' texts, as if a judge had written them."""
    return retrieval.propositions(spark, d).select("id", evaluate.judge_score(F.col("text")).alias("score"))


def q_citations(spark: SparkSession, d: str) -> DataFrame:
    """Marks made from each proposition's numbers, grouped and out of range, and read back."""
    numbers = F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))
    marks = F.concat(F.lit("so [P"), F.array_join(numbers, ", P"), F.lit("] and [P1; P2]"))
    a = retrieval.propositions(spark, d).select(F.col("id").alias("qid"), marks.alias("answer"), F.lit(60).alias("n_propositions"))
    return answer.citations(a).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("cited").alias("total"))


def q_bench_aggregate(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.medians(runs(spark, d), ["system"])
    return m.select("system", "n", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def q_bench_by_hops(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.means_by_hops(runs(spark, d)).select("system", F.coalesce("hops", F.lit(-1)).alias("hops"), F.round("mean_correctness", 6).alias("mean_correctness"), "n")


def q_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "span").select(F.lower("hash").alias("span_hash"), "doc_id", "section_path")
    got = pipelines.ingest_stream(spark, pipelines.as_files(s, 4), scratch_path(spark, "ledger"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def q_stream_rel_state(spark: SparkSession, d: str) -> DataFrame:
    """The edges' state, folded batch by batch: assertions are delivered in three parts, in their order, and the stream is started again for each."""
    a = ingestion.assertions(spark, d)
    cuts = a.agg(F.percentile_approx(F.unix_micros("at"), F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0] or []
    turn = sum(((F.unix_micros("at") > c).cast("int") for c in cuts), F.lit(0))
    source, out = scratch_path(spark, "assertions"), scratch_path(spark, "edges")
    for i in range(len(cuts) + 1):
        a.where(turn == i).write.mode("append").parquet(source)
        got = pipelines.edge_state_stream(spark, source, out, ["predicate"], ingestion.SEQ)
    votes = F.element_at("axis_counts", F.col("axis"))
    return got.select("predicate", "n_assertions", F.round(F.col("base_weight") + 1e-9, 6).alias("base_weight"), votes.alias("top_votes"), F.size("support").alias("n_support"))


def q_event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = pipelines.windowed(table(spark, d, "events"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.sliding(table(spark, d, "events")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def q_event_session(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.sessions(table(spark, d, "events")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def q_event_stream(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.windows_by_stream(spark, table(spark, d, "events").select("ts", "event_type")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


_QUERIES = (
    q_suite_load, q_bench_grid, q_judge_parse, q_citations, q_citation_match, q_citation_pr, q_recall_at_k, q_bench_aggregate, q_bench_by_hops, q_stream_ingest, q_stream_rel_state,
    q_event_tumbling, q_event_sliding, q_event_session, q_event_stream,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_RUNS = """near AS MATERIALIZED (SELECT s.qid, s.rank, p.text, coalesce(p.source_doc, '') || '#' || coalesce(p.source_span, '') ref FROM sp s JOIN prop p ON p.id = s.id WHERE s.rank <= 10),
ev AS MATERIALIZED (SELECT 'graph' system, qid, text, coalesce(source_doc, '') || '#' || source_span ref FROM got UNION ALL SELECT 'nearest', qid, text, ref FROM near),
gold AS MATERIALIZED (SELECT item_id qid, any_value(gold_doc_ids) g, any_value(hops) hops, any_value(gold_answer) ga FROM eval_item GROUP BY 1),
cites AS MATERIALIZED (SELECT DISTINCT system, qid, ref FROM ev),
golds AS MATERIALIZED (SELECT qid, unnest(g) ref, generate_subscripts(g, 1) gi FROM gold),
m AS MATERIALIZED (SELECT c.system, c.qid, c.ref pref, g.gi FROM cites c JOIN golds g ON g.qid = c.qid AND (g.ref = c.ref OR (contains(g.ref, '#') AND contains(c.ref, '#') AND split_part(g.ref, '#', 1) = split_part(c.ref, '#', 1)
  AND lower(trim(string_split(substr(g.ref, instr(g.ref, '#') + 1), '/')[-1])) = lower(trim(string_split(substr(c.ref, instr(c.ref, '#') + 1), '/')[-1]))))),
agg AS MATERIALIZED (SELECT system, qid, count(DISTINCT ref) np FROM ev GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT a.system, a.qid, CASE WHEN len(gold.g) = 0 THEN 0.0::DOUBLE ELSE coalesce(h.hp, 0) / a.np::DOUBLE END p, CASE WHEN len(gold.g) = 0 THEN 1.0::DOUBLE ELSE coalesce(h.hg, 0) / len(gold.g)::DOUBLE END r
  FROM agg a JOIN gold ON gold.qid = a.qid LEFT JOIN (SELECT system, qid, count(DISTINCT pref) hp, count(DISTINCT gi) hg FROM m GROUP BY 1, 2) h ON h.system = a.system AND h.qid = a.qid),
ew AS MATERIALIZED (SELECT DISTINCT system, qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM ev),
gw AS MATERIALIZED (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(ga), '[a-z0-9]+')) w FROM gold),
sz AS MATERIALIZED (SELECT system, qid, sum(len(list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))) tokens, sum(length(text))::DOUBLE chars FROM ev GROUP BY 1, 2),
runs AS MATERIALIZED (SELECT pr.system, pr.qid, gold.hops, least(4, floor(coalesce(i.n, 0) / greatest(gn.n, 1)::DOUBLE * 5))::INT correctness, pr.p, pr.r, sz.chars, sz.tokens FROM pr JOIN gold ON gold.qid = pr.qid JOIN sz ON sz.system = pr.system AND sz.qid = pr.qid
  LEFT JOIN (SELECT qid, count(*) n FROM gw GROUP BY 1) gn ON gn.qid = pr.qid LEFT JOIN (SELECT ew.system, ew.qid, count(*) n FROM ew JOIN gw ON gw.qid = ew.qid AND gw.w = ew.w GROUP BY 1, 2) i ON i.system = pr.system AND i.qid = pr.qid)
"""


def _with_runs(select: str) -> str:
    return with_chain("got", "SELECT 1").replace("\nSELECT 1", f",\n{_RUNS}{select}")


def oracle_sql() -> dict[str, str]:
    med = ", ".join(f"round(CAST(median({c}) AS DOUBLE), 6) median_{n}" for n, c in (("correctness", "correctness"), ("chars_read", "chars"), ("tokens", "tokens"), ("citation_precision", "p"), ("citation_recall", "r")))
    strip = "[](){}.,;:''\"-"
    leaf = "lower(trim(string_split(substr({0}, instr({0}, '#') + 1), '/')[-1]))"
    return {
        "q_suite_load": 'SELECT item_id, any_value(question) question, any_value(gold_answer) gold_answer, any_value(hops) hops, CAST(any_value(len(gold_doc_ids)) AS INT) n_gold FROM eval_item GROUP BY 1',
        "q_bench_grid": "SELECT item_id, system FROM (SELECT DISTINCT item_id FROM eval_item) CROSS JOIN (VALUES ('graph'), ('nearest')) s(system)",
        "q_judge_parse": with_chain("prop", f"SELECT id, coalesce(CAST(list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda t: trim(t, '{strip}')), lambda t: regexp_full_match(t, '[0-4]'))[1] AS INT), 0) score FROM prop"),
        "q_citations": with_chain(
            "prop", "SELECT id qid, count(*) n, CAST(sum(c) AS BIGINT) total FROM (SELECT id, TRY_CAST(x AS BIGINT) c FROM (SELECT id, unnest(list_concat(regexp_extract_all(text, '\\d+'), ['1', '2'])) x FROM prop)) WHERE c BETWEEN 1 AND 60 GROUP BY 1"
        ),
        "q_citation_match": f"""SELECT g.gold, count(*) same_leaf, CAST(sum(CASE WHEN g.gold = p.pred OR (contains(g.gold, '#') AND split_part(g.gold, '#', 1) = split_part(p.pred, '#', 1)) THEN 1 ELSE 0 END) AS BIGINT) same
      FROM (SELECT DISTINCT gold FROM (SELECT unnest(gold_doc_ids) gold FROM eval_item) WHERE gold IS NOT NULL) g JOIN (SELECT DISTINCT source_doc || '#' || coalesce(source_span, '') pred FROM proposition WHERE source_doc IS NOT NULL) p ON {leaf.format("g.gold")} = {leaf.format("p.pred")} GROUP BY 1""",
        "q_citation_pr": _with_runs("SELECT system, qid, round(p, 6) p, round(r, 6) r FROM pr"),
        "q_recall_at_k": with_chain(
            "pick", "SELECT k.qid, round(count(s5.id) / count(*)::DOUBLE, 6) at_5, round(count(s10.id) / count(*)::DOUBLE, 6) at_10 FROM pick k LEFT JOIN sp s5 ON s5.qid = k.qid AND s5.id = k.pid AND s5.rank <= 5 LEFT JOIN sp s10 ON s10.qid = k.qid AND s10.id = k.pid AND s10.rank <= 10 GROUP BY 1"
        ),
        "q_bench_aggregate": _with_runs(f"SELECT system, count(*) n, {med} FROM runs GROUP BY 1"),
        "q_bench_by_hops": _with_runs("SELECT system, coalesce(hops, -1) hops, round(avg(correctness), 6) mean_correctness, count(*) n FROM runs GROUP BY ROLLUP (system, hops) HAVING system IS NOT NULL"),
        "q_stream_ingest": "SELECT doc_id, count(DISTINCT lower(hash)) n FROM span WHERE hash IS NOT NULL GROUP BY 1",
        "q_stream_rel_state": f"WITH {ingestion._fold('predicate')} SELECT w.predicate, w.n_assertions, round(w.base_weight + 1e-9, 6) base_weight, CAST(v.c AS INT) top_votes, CAST(s.cn AS INT) n_support FROM w JOIN vote v USING (predicate) JOIN sup s USING (predicate)",
        "q_event_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') \"start\", event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2",
        "q_event_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M') \"start\", event_type, count(*) n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) s FROM events) GROUP BY 1, 2",
        "q_event_session": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') "start", count(*) n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, g""",
        "q_event_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') \"start\", event_type, count(*) n FROM events GROUP BY 1, 2",
    }
