"""Query-conditioned retrieval over a batch of questions: amplitudes, reweighting, PageRank, ranked propositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.operators.vectors import cosine

UNKNOWN_AXIS = 0.5


def amplitudes(questions: DataFrame, axes: DataFrame, alpha: float = 8.0, beta: float = 0.0) -> DataFrame:
    """qid, axis, amplitude = sigmoid(alpha * cos + beta); five rows a question (the axes are a fixed five-row table)."""
    c = F.coalesce(cosine(F.col("qvec"), F.col("vec"), floor=1e-12), F.lit(0.0))
    return questions.select("qid", "qvec").crossJoin(F.broadcast(axes)).select("qid", "axis_no", "axis", (1 / (1 + F.exp(-(F.lit(alpha) * c + F.lit(beta))))).alias("amplitude"))


def settle_degenerate(amps: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """All amplitudes near 0, or all near 1, tell nothing: then each becomes 1."""
    w = W.partitionBy("qid")
    flat = (F.max("amplitude").over(w) < low) | (F.min("amplitude").over(w) > high)
    return amps.withColumn("amplitude", F.when(flat, F.lit(1.0)).otherwise(F.col("amplitude")))


def reweight(edges: DataFrame, amps: DataFrame) -> DataFrame:
    """Adds weight = base_weight * amplitude of the edge's axis; an unknown axis counts 0.5."""
    a = amps.select("qid", "axis", "amplitude")
    return edges.join(a, ["qid", "axis"], "left").withColumn("weight", F.col("base_weight") * F.coalesce("amplitude", F.lit(UNKNOWN_AXIS))).drop("amplitude")


def _power(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, reset: np.ndarray, damping: float, iterations: int, tol: float) -> np.ndarray:
    out = np.bincount(src, weight, n)
    step = np.divide(weight, out[src], out=np.zeros_like(weight), where=out[src] > 0)
    dangling = out <= 0
    p = reset.copy()
    for _ in range(iterations):
        q = (1 - damping) * reset + damping * (np.bincount(dst, p[src] * step, n) + p[dangling].sum() * reset)
        if tol and np.abs(q - p).sum() < tol:
            return q
        p = q
    return p


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 20, tol: float = 0.0) -> DataFrame:
    """edges(qid, src, dst, weight), seeds(qid, id) -> qid, node, activation.

    One bounded subgraph (`one_hop`'s cap) per question. Reset is uniform over the distinct seeds; parallel edges add up; dangling mass
    restarts at the seeds; without edges each seed has 1 / seeds; without seeds reset is uniform; what no
    seed reaches stays exactly 0."""
    rows = edges.select("qid", "src", "dst", F.col("weight").cast("double").alias("weight")).unionByName(
        seeds.select("qid", "id").distinct().select("qid", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight"))
    )

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e = g[g["dst"].notna()]
        own = g.loc[g["dst"].isna(), "src"]
        names = np.unique(np.concatenate([own, e["src"], e["dst"]]).astype(str))
        at = {x: i for i, x in enumerate(names)}
        reset = np.zeros(len(names))
        reset[[at[x] for x in own]] = 1.0
        reset = reset / reset.sum() if len(own) else np.full(len(names), 1 / max(1, len(names)))
        p = reset if not len(e) else _power(len(names), e["src"].map(at).to_numpy(), e["dst"].map(at).to_numpy(), e["weight"].to_numpy(float), reset, damping, iterations, tol)
        return pd.DataFrame({"qid": g["qid"].iloc[0], "node": names, "activation": p})

    return rows.groupBy("qid").applyInPandas(run, f"qid {edges.schema['qid'].dataType.simpleString()}, node string, activation double")


def assemble(edges: DataFrame, acts: DataFrame, sims: DataFrame, top_m: int = 20) -> DataFrame:
    """qid, pid, score, rank: a proposition scores the best of its supporting edges, max(act(src), act(dst)) * (0.5 + seed
    similarity), and only above 0: evidence from the graph is required."""
    a = acts.select("qid", F.col("node").alias("src"), F.col("activation").alias("a1"))
    b = acts.select("qid", F.col("node").alias("dst"), F.col("activation").alias("a2"))
    s = edges.select("qid", "src", "dst", F.explode("support").alias("pid")).join(a, ["qid", "src"], "left").join(b, ["qid", "dst"], "left")
    best = s.groupBy("qid", "pid").agg(F.max(F.greatest(F.coalesce("a1", F.lit(0.0)), F.coalesce("a2", F.lit(0.0)))).alias("act"))
    sim = sims.select("qid", F.col("id").alias("pid"), "sim")
    scored = best.join(sim, ["qid", "pid"], "left").withColumn("score", F.round(F.col("act") * (F.lit(0.5) + F.coalesce("sim", F.lit(0.0))), 9)).where("score > 0")
    w = W.partitionBy("qid").orderBy(F.desc("score"), "pid")
    return scored.select("qid", "pid", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top_m)


def picked(ranked: DataFrame, seed_props: DataFrame, top_m: int = 20) -> DataFrame:
    """The ranked propositions, then seeds that aren't among them in order of distance; cut at top_m."""
    every = ranked.select("qid", "pid", F.struct(F.lit(0).alias("origin"), F.col("rank").alias("r")).alias("o")).unionByName(
        seed_props.select("qid", F.col("id").alias("pid"), F.struct(F.lit(1).alias("origin"), F.col("rank").alias("r")).alias("o"))
    )
    first = every.groupBy("qid", "pid").agg(F.min("o").alias("o"))
    return first.select("qid", "pid", F.row_number().over(W.partitionBy("qid").orderBy("o")).alias("rank")).where(F.col("rank") <= top_m)


def fetch(pick: DataFrame, propositions: DataFrame, scoped: bool = False) -> DataFrame:
    """The picked propositions' texts, in rank order within a question. Texts are joined last, to the ranked ids only.
    With `scoped`, pick has a source_id too, and only propositions of that source come out."""
    p = propositions.select(F.col("id").alias("pid"), "text", "source_doc", "source_span", "source_id")
    by = ["pid", "source_id"] if scoped else ["pid"]
    return pick.join(p, by).dropDuplicates(["qid", *by])


def graph_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10, every: int = 2) -> DataFrame:
    """PageRank over a graph of any size: a DataFrame loop. seeds(id), edges(src, dst, weight). A step reads the one before it twice, so
    its plan doubles until the next checkpoint: keep `every` small."""
    n = seeds.select("id").distinct()
    start = n.crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("n")))).select("id", (1 / F.col("n")).alias("r"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    step = edges.join(out, "src").where("out > 0").groupBy("src", "dst").agg(F.sum(F.col("weight") / F.col("out")).alias("t")).checkpoint()
    p = start.select("id", F.col("r").alias("p"))
    for i in range(iterations):
        sent = p.join(step, p["id"] == step["src"]).select(F.col("dst").alias("id"), (F.col("p") * F.col("t")).alias("x"))
        kept = sent.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("kept"))
        back = start.crossJoin(F.broadcast(kept)).select("id", (F.col("r") * (1 - F.lit(damping) * F.col("kept"))).alias("x"))
        p = sent.select("id", (F.col("x") * damping).alias("x")).unionByName(back).groupBy("id").agg(F.sum("x").alias("p"))
        if (i + 1) % every == 0:
            p = p.checkpoint()
    return p
