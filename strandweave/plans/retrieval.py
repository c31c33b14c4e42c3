"""Queries over the graph and the retrieval path, for all questions of eval_item at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.axes import AXES, AXIS_TEXTS, NO_INFO
from strandweave.config import Config
from strandweave.operators import answer, complete, evaluate, graph, retrieve, vectors
from strandweave.operators.buckets import bucket_top_k
from strandweave.session import materialise, shared_dir
from strandweave.sources.tables import ref_id, table

CFG = Config()


class Retrieval:
    """One batch of questions over one set of tables. What several steps need is computed once, written to the shared folder and read from there:
    the embedded questions, the seeds, the subgraph and the amplitudes, all bounded by the number of questions. Each table is scanned once for it."""

    def __init__(self, spark: SparkSession, d, asked: DataFrame | None = None, source_id: str | None = None):
        self.spark, self.d, self.asked, self.source_id = spark, d, asked, source_id

    def table(self, name: str) -> DataFrame:
        t = table(self.spark, self.d, name) if isinstance(self.d, str) else self.d.table(name)  # a folder of tables, or a store
        return t if self.source_id is None else t.where(F.col("source_id") == self.source_id)

    @cached_property
    def questions(self) -> DataFrame:
        q = self.asked
        if q is None:
            q = table(self.spark, self.d, "eval_item").select(F.col("item_id").alias("qid"), "question").dropDuplicates(["qid"])
        return materialise(vectors.embed(q, "question", "qvec", CFG.embedding.dim, CFG.embedding.provider), "questions")

    @property
    def edges(self) -> DataFrame:
        return graph.edge_rows(self.table("rel"))

    @property
    def propositions(self) -> DataFrame:
        return graph.living(self.table("proposition"))

    @cached_property
    def seed_entities(self) -> DataFrame:
        return materialise(vectors.top_k(self.questions, graph.living(self.table("entity")), CFG.retrieve.seed_k_entities), "seed-entities")

    @cached_property
    def seed_props(self) -> DataFrame:
        return materialise(vectors.top_k(self.questions, self.propositions, CFG.retrieve.seed_k_propositions), "seed-props").withColumn("sim", 1 - F.col("distance"))

    @cached_property
    def subgraph(self) -> DataFrame:
        return materialise(graph.hops(self.seed_entities, self.edges, CFG.retrieve.hops, CFG.retrieve.max_subgraph_edges), "subgraph")

    @cached_property
    def amplitudes(self) -> DataFrame:
        return materialise(retrieve.amplitudes(self.questions, vectors.axis_vectors(self.spark), CFG.reweight.alpha, CFG.reweight.beta), "amplitudes")

    @property
    def weighted(self) -> DataFrame:
        return retrieve.reweight(self.subgraph, retrieve.settle_degenerate(self.amplitudes))

    @property
    def activations(self) -> DataFrame:
        return retrieve.personalized_pagerank(self.weighted, self.seed_entities, CFG.rank.damping, CFG.rank.iterations)

    @property
    def ranked(self) -> DataFrame:
        return retrieve.assemble(self.subgraph, self.activations, self.seed_props, CFG.rank.top_m)

    @cached_property
    def chosen(self) -> DataFrame:
        return materialise(retrieve.picked(self.ranked, self.seed_props, CFG.rank.top_m), "chosen")

    @cached_property
    def fetched(self) -> DataFrame:
        return materialise(retrieve.fetch(self.chosen, self.propositions), "fetched")

    def nearest(self, k: int) -> DataFrame:
        """The baseline without graph: the k nearest propositions with their texts."""
        return retrieve.fetch(self.seed_props.where(F.col("rank") <= k).select("qid", F.col("id").alias("pid"), "rank"), self.propositions)


def propositions(spark: SparkSession, d: str) -> DataFrame:
    return graph.live(table(spark, d, "proposition"))


# ---------------------------------------------------------------- vectors


def q_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each mention's entity and proposition."""
    m = table(spark, d, "mentions").select(ref_id("proposition_id").alias("pid"), ref_id("entity_id").alias("eid")).where("pid IS NOT NULL").distinct()
    e = graph.live(table(spark, d, "entity")).where(vectors.usable("embedding")).select(F.col("id").alias("eid"), F.col("embedding").alias("a"))
    p = propositions(spark, d).where(vectors.usable("embedding")).select(F.col("id").alias("pid"), F.col("embedding").alias("b"))
    return m.join(e, "eid").join(p, "pid").select("pid", "eid", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def q_l2_norm(spark: SparkSession, d: str) -> DataFrame:
    e = graph.live(table(spark, d, "entity")).where(vectors.usable("embedding"))
    n = vectors.normalised(F.col("embedding"))
    return e.select("id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.element_at(n, 64), 6).alias("last"))


def q_embed(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).questions.select("qid", F.posexplode("qvec").alias("dim", "value")).where("value <> 0").select("qid", "dim", F.col("value").cast("double").alias("value"))


def q_seed_entities(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).seed_entities.select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


def q_seed_props(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).seed_props.select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


# ---------------------------------------------------------------- graph


def q_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph.PropertyGraph(graph.live(table(spark, d, "entity")), graph.edges(table(spark, d, "rel")))
    return graph.bound_edges(g).select("id", "src_name", "predicate", "dst_name")


def q_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions edges, the role checked, one per (proposition, entity, role)."""
    m = table(spark, d, "mentions").where(F.col("role").isin("subject", "object")).select(ref_id("proposition_id").alias("pid"), ref_id("entity_id").alias("eid"), "role", "confidence")
    return m.where("pid IS NOT NULL").groupBy("pid", "eid", "role").agg(F.max("confidence").alias("confidence"))


def q_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).subgraph.select("qid", "id", "edge_no")


def q_two_hops(spark: SparkSession, d: str) -> DataFrame:
    r = Retrieval(spark, d)
    return graph.hops(r.seed_entities, r.edges, 2, CFG.retrieve.max_subgraph_edges).select("qid", "id", "edge_no")


def q_source_scope(spark: SparkSession, d: str) -> DataFrame:
    """The one-hop edges of questions that ask all sources together, counted by source; the q_scoped queries ask each source alone."""
    return Retrieval(spark, d).subgraph.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("qid").alias("n_questions"))


def q_scoped_hop(spark: SparkSession, d: str) -> DataFrame:
    """Each question asks each source alone: seeds and edges of that source only, both cut per (question, source)."""
    r = Retrieval(spark, d)
    seeds = materialise(vectors.top_k(r.questions, graph.living(table(spark, d, "entity")), CFG.retrieve.seed_k_entities, scope="source_id"), "scoped-seeds")
    return graph.hops(seeds, r.edges, CFG.retrieve.hops, CFG.retrieve.max_subgraph_edges, scoped=True).select("qid", "source_id", "id", "edge_no")


def q_scoped_props(spark: SparkSession, d: str) -> DataFrame:
    """The propositions nearest to each question within each source, with their texts."""
    r = Retrieval(spark, d)
    near = vectors.top_k(r.questions, r.propositions, CFG.retrieve.seed_k_propositions, scope="source_id")
    got = retrieve.fetch(near.withColumnRenamed("id", "pid"), r.propositions, scoped=True)
    return got.select("qid", "source_id", "pid", F.round(1 - F.col("distance"), 6).alias("sim"), "rank", "text")


def q_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("source_id") for t in ("entity", "proposition", "rel")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("source_id IS NOT NULL").distinct().orderBy("source_id")


def q_amplitude(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).amplitudes.select("qid", "axis", F.round("amplitude", 6).alias("amplitude"))


def q_amp_degenerate(spark: SparkSession, d: str) -> DataFrame:
    """The fallback on questions of either kind: as they are, and with a steep sigmoid that saturates."""
    q = Retrieval(spark, d).questions
    out = [retrieve.settle_degenerate(retrieve.amplitudes(q, vectors.axis_vectors(spark), 8.0, b)).select("qid", "axis", F.lit(b).alias("beta"), F.round("amplitude", 6).alias("amplitude")) for b in (0.0, 9.0, -9.0)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def q_amp_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = retrieve.settle_degenerate(Retrieval(spark, d).amplitudes).groupBy("qid").pivot("axis", list(AXES)).agg(F.max("amplitude"))
    return p.select("qid", *[F.round(F.coalesce(a, F.lit(0.0)), 6).alias(a) for a in AXES])


def q_reweight(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).weighted.select("qid", "id", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


def q_ppr(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).activations.select("qid", "node", F.round("activation", 6).alias("activation"))


def q_ppr_noedge(spark: SparkSession, d: str) -> DataFrame:
    r = Retrieval(spark, d)
    none = r.weighted.where(F.lit(False))
    return retrieve.personalized_pagerank(none, r.seed_entities).select("qid", "node", F.round("activation", 6).alias("activation"))


def q_viz_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What a drawing of each question's subgraph needs: node sizes, and the label."""
    a = Retrieval(spark, d).activations
    return a.select("qid", "node", F.left("node", F.lit(8)).alias("label"), F.round(F.greatest("activation", F.lit(0.01)) * 100, 4).alias("size"))


def q_viz_edges(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).weighted.select("qid", "id", F.coalesce("axis", F.lit("")).alias("label"), F.round(F.greatest("weight", F.lit(0.01)) * 10 + 1e-9, 6).alias("width"))


def q_assemble(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).ranked.select("qid", "pid", F.round("score", 6).alias("score"))


def q_picked(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).chosen


def q_fetch_props(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).fetched.select("qid", "rank", "pid", "text", "source_doc", F.coalesce("source_span", F.lit("")).alias("source_span"))


def q_budget(spark: SparkSession, d: str) -> DataFrame:
    """The evidence that fits a budget of 300 tokens."""
    r = Retrieval(spark, d)
    return answer.within_budget(r.fetched, r.questions, 300).select("qid", "rank", "pid", "cost")


def prompts(r: Retrieval) -> DataFrame:
    return answer.answer_prompts(answer.within_budget(r.fetched, r.questions, CFG.answer.budget_tokens), r.questions)


def q_answer_prompt(spark: SparkSession, d: str) -> DataFrame:
    return prompts(Retrieval(spark, d))


def q_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the offline back-end, which cites all the evidence it is given, and the citations read from them."""
    a = materialise(complete.answers(prompts(Retrieval(spark, d))), "answers")
    n = answer.citations(a).groupBy("qid").agg(F.countDistinct("cited").alias("n_cited"))
    return a.join(n, "qid", "left").select("qid", "answer", F.coalesce("n_cited", F.lit(0)).alias("n_cited"))


def q_judged(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the nearest proposition's text against the gold answer, by the offline back-end."""
    items = table(spark, d, "eval_item").dropDuplicates(["item_id"]).select(F.col("item_id").alias("qid"), "question", "gold_answer")
    best = Retrieval(spark, d).nearest(1).select("qid", F.col("text").alias("answer"))
    asked = complete.complete(complete.judge_prompts(items.join(best, "qid", "left")), "prompt", "reply")
    return asked.select("qid", evaluate.judge_score(F.col("reply")).alias("score"))


def q_naive_citations(spark: SparkSession, d: str) -> DataFrame:
    """The baseline without graph: the ten nearest propositions, all of them cited."""
    return Retrieval(spark, d).nearest(10).select("qid", F.concat(F.coalesce("source_doc", F.lit("")), F.lit("#"), F.coalesce("source_span", F.lit(""))).alias("citation")).distinct()


def q_graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank over the whole graph, restarted at all entities that some question's seeds name."""
    shared_dir(spark)
    e = graph.edges(table(spark, d, "rel")).select("src", "dst", F.col("base_weight").alias("weight")).where("weight > 0")
    p = retrieve.graph_pagerank(e, Retrieval(spark, d).seed_entities.select("id").distinct())
    return p.select("id", F.round("p", 6).alias("p"))


def q_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Hyperplane buckets against the exact top-k of entities: recall per question."""
    r = Retrieval(spark, d)
    exact = r.seed_entities.select("qid", "id")
    near = bucket_top_k(r.questions, graph.living(table(spark, d, "entity")), CFG.retrieve.seed_k_entities).select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


# ---------------------------------------------------------------- the same in SQL

_HASH = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_BUCKET = "CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 64"
_SIGN = "CASE WHEN CAST(('0x' || substr(md5(w), 5, 1)) AS INT) < 8 THEN 1 ELSE -1 END"
_OK = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_NORM = "lower(replace({x}, '-', ''))"


def _vec(src: str) -> str:
    """(k, text) of src to (k, v): the hashed words of the text as 64 numbers."""
    return f"""SELECT k, list(v ORDER BY dim) v FROM (
      SELECT s.k, r.dim, CAST(coalesce(sum(h.s), 0) AS DOUBLE) v FROM {src} s CROSS JOIN (SELECT unnest(range(64)) dim) r
      LEFT JOIN (SELECT k, {_BUCKET} b, {_SIGN} s FROM (SELECT k, unnest({_HASH.format(x="text")}) w FROM {src})) h ON h.k = s.k AND h.b = r.dim GROUP BY 1, 2) GROUP BY 1"""


def _topk(t: str, k: int) -> str:
    return f"""SELECT qid, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) rank FROM (
      SELECT q.qid, e.id, round(1 - list_cosine_similarity(q.qvec, CAST(e.embedding AS DOUBLE[])), 9) distance FROM q CROSS JOIN (SELECT * FROM {t} WHERE {_OK}) e)) WHERE rank <= {k}"""


def _scoped_topk(t: str, k: int) -> str:
    return f"""SELECT qid, source_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY distance, id) rank FROM (
      SELECT q.qid, e.source_id, e.id, round(1 - list_cosine_similarity(q.qvec, CAST(e.embedding AS DOUBLE[])), 9) distance FROM q CROSS JOIN (SELECT * FROM {t} WHERE {_OK} AND source_id IS NOT NULL) e)) WHERE rank <= {k}"""


def _power_steps(n: int) -> list[tuple[str, str]]:
    steps = []
    for i in range(n):
        prev = f"p{i}"
        steps.append(
            (
                f"p{i + 1}",
                f"""SELECT n.qid, n.node, 0.15 * n.r + 0.85 * (coalesce(f.x, 0) + dm.m * n.r) p FROM nodes n
      LEFT JOIN (SELECT t.qid, t.dst node, sum(t.t * p.p) x FROM steps t JOIN {prev} p ON p.qid = t.qid AND p.node = t.src GROUP BY 1, 2) f ON f.qid = n.qid AND f.node = n.node
      JOIN (SELECT n.qid, sum(CASE WHEN n.o IS NULL OR n.o <= 0 THEN p.p ELSE 0 END) m FROM nodes n JOIN {prev} p ON p.qid = n.qid AND p.node = n.node GROUP BY 1) dm ON dm.qid = n.qid""",
            )
        )
    return steps


_AXES = ", ".join(f"({i}, '{a}', '{AXIS_TEXTS[a]}')" for i, a in enumerate(AXES))
_LIVE = "SELECT id, {c} FROM {t} GROUP BY id HAVING count(deleted_at) = 0"
_CHAIN: list[tuple[str, str]] = [
    ("ent", _LIVE.format(t="entity", c="any_value(name) name, any_value(embedding) embedding, any_value(source_id) source_id")),
    ("prop", _LIVE.format(t="proposition", c="any_value(text) text, any_value(source_doc) source_doc, any_value(source_span) source_span, any_value(embedding) embedding, any_value(source_id) source_id")),
    (
        "edge",
        f"""SELECT id, {_NORM.format(x="src_id")} src, {_NORM.format(x="dst_id")} dst, predicate, axis, coalesce(base_weight, 0) base_weight,
      list_transform(list_filter(support, lambda x: x IS NOT NULL), lambda x: {_NORM.format(x="x")}) support, source_id
      FROM (SELECT id, any_value(src_id) src_id, any_value(dst_id) dst_id, any_value(predicate) predicate, any_value(ontology_axis) axis, any_value(base_weight) base_weight,
      any_value(support_propositions) support, any_value(source_id) source_id FROM rel GROUP BY id) WHERE src_id IS NOT NULL AND dst_id IS NOT NULL""",
    ),
    ("qs", "SELECT item_id k, any_value(question) text FROM eval_item GROUP BY 1"),
    ("q", f"SELECT qs.k qid, qs.text question, v.v qvec FROM qs JOIN ({_vec('qs')}) v ON v.k = qs.k"),
    ("ax", f"SELECT * FROM (VALUES {_AXES}) t(no, k, text)"),
    ("axv", f"SELECT k axis, v vec FROM ({_vec('ax')})"),
    ("se", _topk("ent", 8)),
    ("sp", _topk("prop", 16)),
    (
        "hop",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_weight DESC, src, dst, predicate, id) edge_no FROM (
      SELECT DISTINCT ON (s.qid, e.id) s.qid, e.* FROM edge e JOIN se s ON s.id = e.src OR s.id = e.dst)) WHERE edge_no <= 2048""",
    ),
    (
        "ampraw",
        "SELECT q.qid, a.axis, list_dot_product(q.qvec, a.vec) / (greatest(sqrt(list_dot_product(q.qvec, q.qvec)), 1e-12) * greatest(sqrt(list_dot_product(a.vec, a.vec)), 1e-12)) c FROM q CROSS JOIN axv a",
    ),
    ("amp", "SELECT qid, axis, 1 / (1 + exp(-8 * c)) amplitude FROM ampraw"),
    ("amps", "SELECT qid, axis, CASE WHEN max(amplitude) OVER w < 0.05 OR min(amplitude) OVER w > 0.95 THEN 1 ELSE amplitude END amplitude FROM amp WINDOW w AS (PARTITION BY qid)"),
    ("rw", "SELECT h.*, h.base_weight * coalesce(a.amplitude, 0.5) weight FROM hop h LEFT JOIN amps a ON a.qid = h.qid AND a.axis = h.axis"),
    (
        "nodes",
        """SELECT n.qid, n.node, coalesce(1.0 / s.c, 0)::DOUBLE r, o.o FROM (SELECT qid, id node FROM se UNION SELECT qid, src FROM rw UNION SELECT qid, dst FROM rw) n
      LEFT JOIN (SELECT qid, id, count(*) OVER (PARTITION BY qid) c FROM se) s ON s.qid = n.qid AND s.id = n.node
      LEFT JOIN (SELECT qid, src, sum(weight) o FROM rw GROUP BY 1, 2) o ON o.qid = n.qid AND o.src = n.node""",
    ),
    ("steps", "SELECT rw.qid, rw.src, rw.dst, sum(rw.weight / n.o) t FROM rw JOIN nodes n ON n.qid = rw.qid AND n.node = rw.src WHERE n.o > 0 GROUP BY 1, 2, 3"),
    ("p0", "SELECT qid, node, r p FROM nodes"),
    *_power_steps(20),
    (
        "asm",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) rank FROM (
      SELECT s.qid, s.pid, round(s.act * (0.5 + coalesce(1 - sp.distance, 0)), 9) score FROM (
        SELECT x.qid, x.pid, max(greatest(coalesce(a.p, 0), coalesce(b.p, 0))) act FROM (SELECT qid, src, dst, unnest(support) pid FROM hop) x
        LEFT JOIN p20 a ON a.qid = x.qid AND a.node = x.src LEFT JOIN p20 b ON b.qid = x.qid AND b.node = x.dst GROUP BY 1, 2) s
      LEFT JOIN sp ON sp.qid = s.qid AND sp.id = s.pid) WHERE score > 0) WHERE rank <= 20""",
    ),
    (
        "pick",
        """SELECT qid, pid, rank FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY o, r) rank FROM (
      SELECT qid, pid, o, r FROM (SELECT *, row_number() OVER (PARTITION BY qid, pid ORDER BY o, r) f FROM (SELECT qid, pid, 0 o, rank r FROM asm UNION ALL SELECT qid, id, 1, rank FROM sp)) WHERE f = 1)) WHERE rank <= 20""",
    ),
    ("got", "SELECT k.qid, k.rank, k.pid, p.text, p.source_doc, coalesce(p.source_span, '') source_span FROM pick k JOIN prop p ON p.id = k.pid"),
    ("cost", "SELECT g.*, length(q.question) + 200 + sum(coalesce(length(g.text), 0) + 100) OVER (PARTITION BY g.qid ORDER BY g.rank) cost, row_number() OVER (PARTITION BY g.qid ORDER BY g.rank) n FROM got g JOIN q ON q.qid = g.qid"),
]


def with_chain(last: str, select: str) -> str:
    upto = [n for n, _ in _CHAIN].index(last) + 1
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in _CHAIN[:upto]) + "\n" + select


def _pagerank_sql(iterations: int = 10) -> str:
    """The loop of graph_pagerank, a table for each round."""
    steps = ["g0 AS MATERIALIZED (SELECT id, r, r p FROM (SELECT id, 1 / count(*) OVER ()::DOUBLE r FROM (SELECT DISTINCT id FROM se)))"]
    for i in range(iterations):
        steps.append(f"sent{i} AS MATERIALIZED (SELECT t.dst, g.p * t.t x FROM g{i} g JOIN turn t ON t.src = g.id)")
        back = f"SELECT id, r * (1 - 0.85 * (SELECT coalesce(sum(x), 0) FROM sent{i})) FROM g0"
        steps.append(f"g{i + 1} AS MATERIALIZED (SELECT id, sum(x) p FROM (SELECT dst id, 0.85 * x x FROM sent{i} UNION ALL {back}) GROUP BY 1)")
    return with_chain("se", "").rstrip() + f""",
pos AS MATERIALIZED (SELECT src, dst, base_weight w FROM edge WHERE base_weight > 0),
turn AS MATERIALIZED (SELECT src, dst, sum(w / o) t FROM pos JOIN (SELECT src, sum(w) o FROM pos GROUP BY 1) USING (src) GROUP BY 1, 2),
{", ".join(steps)} SELECT id, round(p, 6) p FROM g{iterations}"""


_QUERIES = (
    q_cosine, q_l2_norm, q_embed, q_seed_entities, q_seed_props, q_graph_edges, q_mentions, q_one_hop, q_two_hops, q_source_scope, q_scoped_hop, q_scoped_props, q_sources, q_amplitude, q_amp_degenerate, q_amp_pivot,
    q_reweight, q_ppr, q_ppr_noedge, q_viz_nodes, q_viz_edges, q_assemble, q_picked, q_fetch_props, q_budget, q_answer_prompt, q_answers, q_judged, q_naive_citations, q_graph_pagerank, q_ann_recall,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    settle = "SELECT qid, axis, CAST({b} AS DOUBLE) beta, round(CASE WHEN max(a) OVER w < 0.05 OR min(a) OVER w > 0.95 THEN 1 ELSE a END, 6) amplitude FROM (SELECT qid, axis, 1 / (1 + exp(-(8 * c + ({b})))) a FROM ampraw) WINDOW w AS (PARTITION BY qid)"
    pivot = ", ".join(f"round(max(CASE WHEN axis = '{a}' THEN amplitude END), 6) {a}" for a in AXES)
    no_info = NO_INFO.replace("'", "''")
    two = """hop2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_weight DESC, src, dst, predicate, id) edge_no FROM (
      SELECT DISTINCT ON (s.qid, e.id) s.qid, e.* FROM (SELECT qid, src n FROM hop UNION SELECT qid, dst FROM hop) s JOIN edge e ON s.n = e.src OR s.n = e.dst)) WHERE edge_no <= 2048)"""
    return {
        "q_cosine": with_chain(
            "prop",
            f"""SELECT m.pid, m.eid, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) cosine
      FROM (SELECT DISTINCT {_NORM.format(x="proposition_id")} pid, {_NORM.format(x="entity_id")} eid FROM mentions WHERE proposition_id IS NOT NULL) m
      JOIN (SELECT * FROM ent WHERE {_OK}) e ON e.id = m.eid JOIN (SELECT * FROM prop WHERE {_OK}) p ON p.id = m.pid""",
        ),
        "q_l2_norm": with_chain(
            "ent", f"SELECT id, round(n, 6) norm, round(v[1] / n, 6) \"first\", round(v[64] / n, 6) \"last\" FROM (SELECT id, CAST(embedding AS DOUBLE[]) v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) n FROM ent WHERE {_OK})"
        ),
        "q_embed": with_chain("q", "SELECT qid, CAST(i - 1 AS INT) dim, qvec[i] \"value\" FROM (SELECT qid, qvec, unnest(range(1, 65)) i FROM q) WHERE qvec[i] <> 0"),
        "q_seed_entities": with_chain("se", "SELECT qid, id, round(distance, 6) distance, CAST(rank AS INT) rank FROM se"),
        "q_seed_props": with_chain("sp", "SELECT qid, id, round(1 - distance, 6) sim, CAST(rank AS INT) rank FROM sp"),
        "q_graph_edges": with_chain("edge", "SELECT e.id, s.name src_name, e.predicate, t.name dst_name FROM edge e JOIN ent s ON s.id = e.src JOIN ent t ON t.id = e.dst"),
        "q_mentions": f"SELECT {_NORM.format(x='proposition_id')} pid, {_NORM.format(x='entity_id')} eid, role, max(confidence) confidence FROM mentions WHERE role IN ('subject', 'object') AND proposition_id IS NOT NULL GROUP BY 1, 2, 3",
        "q_one_hop": with_chain("hop", "SELECT qid, id, CAST(edge_no AS INT) edge_no FROM hop"),
        "q_two_hops": with_chain("hop", "SELECT qid, id, CAST(edge_no AS INT) edge_no FROM hop2").replace("\nSELECT qid, id, CAST", f",\n{two}\nSELECT qid, id, CAST"),
        "q_source_scope": with_chain("hop", "SELECT source_id, count(*) n_edges, count(DISTINCT qid) n_questions FROM hop GROUP BY 1"),
        "q_scoped_hop": with_chain(
            "q",
            f"""SELECT qid, source_id, id, CAST(edge_no AS INT) edge_no FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY base_weight DESC, src, dst, predicate, id) edge_no FROM (
      SELECT DISTINCT ON (s.qid, e.id) s.qid, e.* FROM edge e JOIN ({_scoped_topk("ent", 8)}) s ON s.source_id = e.source_id AND (s.id = e.src OR s.id = e.dst))) WHERE edge_no <= 2048""",
        ),
        "q_scoped_props": with_chain("q", f"SELECT s.qid, s.source_id, s.id pid, round(1 - s.distance, 6) sim, CAST(s.rank AS INT) rank, p.text FROM ({_scoped_topk('prop', 16)}) s JOIN prop p ON p.id = s.id"),
        "q_sources": "SELECT source_id FROM entity WHERE source_id IS NOT NULL UNION SELECT source_id FROM proposition WHERE source_id IS NOT NULL UNION SELECT source_id FROM rel WHERE source_id IS NOT NULL",
        "q_amplitude": with_chain("amp", "SELECT qid, axis, round(amplitude, 6) amplitude FROM amp"),
        "q_amp_degenerate": with_chain("ampraw", " UNION ALL ".join(settle.format(b=b) for b in ("0.0", "9.0", "-9.0"))),
        "q_amp_pivot": with_chain("amps", f"SELECT qid, {pivot} FROM amps GROUP BY 1"),
        "q_reweight": with_chain("rw", "SELECT qid, id, round(weight + 1e-9, 6) weight FROM rw"),
        "q_ppr": with_chain("p20", "SELECT qid, node, round(p, 6) activation FROM p20"),
        "q_graph_pagerank": _pagerank_sql(),
        "q_ppr_noedge": with_chain("se", "SELECT qid, id node, round(1.0::DOUBLE / count(*) OVER (PARTITION BY qid), 6) activation FROM se"),
        "q_viz_nodes": with_chain("p20", "SELECT qid, node, substr(node, 1, 8) \"label\", round(greatest(p, 0.01) * 100, 4) size FROM p20"),
        "q_viz_edges": with_chain("rw", "SELECT qid, id, coalesce(axis, '') \"label\", round(greatest(weight, 0.01) * 10 + 1e-9, 6) width FROM rw"),
        "q_assemble": with_chain("asm", "SELECT qid, pid, round(score, 6) score FROM asm"),
        "q_picked": with_chain("pick", "SELECT qid, pid, CAST(rank AS INT) rank FROM pick"),
        "q_fetch_props": with_chain("got", "SELECT qid, CAST(rank AS INT) rank, pid, text, source_doc, source_span FROM got"),
        "q_budget": with_chain("cost", "SELECT qid, CAST(rank AS INT) rank, pid, CAST(cost AS BIGINT) cost FROM cost WHERE cost <= 1200 OR n = 1"),
        "q_answer_prompt": with_chain(
            "cost",
            f"""SELECT q.qid, coalesce(c.n, 0) n_propositions, CASE WHEN c.n IS NULL THEN '{no_info}' ELSE 'Use only the numbered propositions and cite each claim by its mark.' || chr(10) || c.e || chr(10) || 'Question: ' || q.question END prompt
      FROM q LEFT JOIN (SELECT qid, count(*) n, string_agg('[P' || n || '] (' || coalesce(source_doc, '') || '#' || source_span || ') ' || coalesce(text, ''), chr(10) ORDER BY n) e FROM cost WHERE cost <= 16000 OR n = 1 GROUP BY 1) c ON c.qid = q.qid""",
        ),
        "q_answers": with_chain(
            "cost",
            f"""SELECT q.qid, coalesce('It is stated in ' || c.m || '.', '{no_info}') answer, coalesce(c.n, 0) n_cited
      FROM q LEFT JOIN (SELECT qid, count(*) n, string_agg('[P' || n || ']', ', ' ORDER BY n) m FROM cost WHERE cost <= 16000 OR n = 1 GROUP BY 1) c ON c.qid = q.qid""",
        ),
        "q_judged": with_chain(
            "sp",
            """, gw AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(ga), '[a-z0-9]+')) w FROM (SELECT item_id qid, any_value(gold_answer) ga FROM eval_item GROUP BY 1)),
      aw AS (SELECT DISTINCT s.qid, unnest(regexp_extract_all(lower(p.text), '[a-z0-9]+')) w FROM sp s JOIN prop p ON p.id = s.id WHERE s.rank = 1)
      SELECT q.qid, CAST(least(4, coalesce(5 * h.n // greatest(1, g.n), 0)) AS INT) score FROM q LEFT JOIN (SELECT qid, count(*) n FROM gw GROUP BY 1) g ON g.qid = q.qid
      LEFT JOIN (SELECT gw.qid, count(*) n FROM gw JOIN aw ON aw.qid = gw.qid AND aw.w = gw.w GROUP BY 1) h ON h.qid = q.qid""",
        ),
        "q_naive_citations": with_chain("sp", "SELECT DISTINCT s.qid, coalesce(p.source_doc, '') || '#' || coalesce(p.source_span, '') citation FROM sp s JOIN prop p ON p.id = s.id WHERE s.rank <= 10"),
    }
