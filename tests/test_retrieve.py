import math
import random

import pytest
from pyspark.sql import functions as F

from strandweave.axes import AXES
from strandweave.operators import graph, retrieve, vectors


def test_amplitudes(spark):
    axes = spark.createDataFrame([(i, a, [float(i == j) for j in range(5)]) for i, a in enumerate(AXES)], "axis_no int, axis string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0, 0.0]), ("n", [-1.0, 0.0, 0.0, 0.0, 0.0]), ("z", [0.0] * 5), ("h", [0.5, 0.0, 0.0, 0.0, 0.0])], "qid string, qvec array<float>")
    a = {(r.qid, r.axis): r.amplitude for r in retrieve.amplitudes(q, axes).collect()}
    assert a["q", "causal"] == pytest.approx(0.999665, abs=1e-6) and a["q", "temporal"] == 0.5
    assert a["n", "causal"] == pytest.approx(0.000335, abs=1e-6) and a["z", "causal"] == 0.5
    assert a["h", "causal"] == pytest.approx(a["q", "causal"])  # the question is normalised first


def test_degenerate(spark):
    rows = [("low", a, 0.01) for a in AXES] + [("high", a, 0.99) for a in AXES] + [("mixed", a, 0.01 if a == "causal" else 0.5) for a in AXES]
    got = retrieve.settle_degenerate(spark.createDataFrame(rows, "qid string, axis string, amplitude double")).collect()
    assert {r.amplitude for r in got if r.qid != "mixed"} == {1.0}
    assert {r.amplitude for r in got if r.qid == "mixed"} == {0.01, 0.5}


def test_reweight_keeps_unknown_axes_at_half(spark):
    e = spark.createDataFrame([("q", "e1", "causal", 0.8), ("q", "e2", "no such", 0.8), ("q", "e3", None, 0.8)], "qid string, id string, axis string, base_weight double")
    a = spark.createDataFrame([("q", "causal", 0.99)], "qid string, axis string, amplitude double")
    got = {r.id: r.weight for r in retrieve.reweight(e, a).collect()}
    assert got["e1"] == pytest.approx(0.792) and got["e2"] == pytest.approx(0.4) and got["e3"] == pytest.approx(0.4)


CASES = {
    "chain": ([("a", "b", 0.9), ("b", "c", 0.9), ("x", "y", 0.9)], ["a"], {"a": 0.388727, "b": 0.330418, "c": 0.280855, "x": 0, "y": 0}),
    "fork": ([("a", "b", 0.9), ("a", "c", 0.1)], ["a"], {"a": 0.540541, "b": 0.413514, "c": 0.045946}),
    "two seeds": ([("a", "b", 0.9), ("x", "y", 0.9)], ["a", "x"], {"a": 0.270270, "x": 0.270270, "b": 0.229730, "y": 0.229730}),
    "isolated seed": ([("b", "c", 0.9)], ["a"], {"a": 1, "b": 0, "c": 0}),
    "no edges": ([], ["a", "b", "a"], {"a": 0.5, "b": 0.5}),
    "parallel edges": ([("a", "b", 0.2), ("a", "b", 0.7), ("a", "c", 0.1)], ["a"], {"a": 0.540541, "b": 0.413514, "c": 0.045946}),
}


def test_pagerank_by_definition(spark):
    e = spark.createDataFrame([(k, *x) for k, (es, _, _) in CASES.items() for x in es], "qid string, src string, dst string, weight double")
    s = spark.createDataFrame([(k, x) for k, (_, ss, _) in CASES.items() for x in ss], "qid string, id string")
    got = {}
    for r in retrieve.personalized_pagerank(e, s, iterations=400, tol=1e-12).collect():
        got.setdefault(r.qid, {})[r.node] = r.activation
    for k, (_, _, want) in CASES.items():
        assert set(got[k]) == set(want)
        for n, v in want.items():
            assert got[k][n] == pytest.approx(v, abs=2e-6), (k, n)
            assert v or got[k][n] == 0.0  # exactly


def test_pagerank_of_a_large_graph_is_the_same(spark):
    from strandweave.session import shared_dir

    shared_dir(spark)
    es, ss, want = CASES["chain"]
    p = retrieve.graph_pagerank(spark.createDataFrame(es, "src string, dst string, weight double"), spark.createDataFrame([(x,) for x in ss], "id string"), iterations=20, every=1)
    got = {r.id: r.p for r in p.collect()}
    for n, v in want.items():
        assert got.get(n, 0.0) == pytest.approx(v, abs=0.05)


def test_assemble_needs_evidence_from_the_graph(spark):
    e = spark.createDataFrame([("q", "a", "b", ["p1", "p2"]), ("q", "x", "y", ["p3"]), ("q", "a", "b", ["p1"]), ("q", "a", "b", ["p4"])], "qid string, src string, dst string, support array<string>")
    a = spark.createDataFrame([("q", "a", 0.4), ("q", "b", 0.2), ("q", "x", 0.0)], "qid string, node string, activation double")
    s = spark.createDataFrame([("q", "p1", 0.5), ("q", "p3", 1.0), ("q", "p4", -0.9)], "qid string, id string, sim double")
    got = {r.pid: (r.score, r.rank) for r in retrieve.assemble(e, a, s, 20).collect()}
    assert got == {"p1": (0.4, 1), "p2": (0.2, 2)}


def test_picked_puts_seeds_behind(spark):
    ranked = spark.createDataFrame([("q", "p1", 1), ("q", "p2", 2)], "qid string, pid string, rank int")
    seeds = spark.createDataFrame([("q", "p2", 1), ("q", "p9", 2), ("r", "p5", 1)], "qid string, id string, rank int")
    got = [(r.qid, r.pid, r.rank) for r in retrieve.picked(ranked, seeds, 3).orderBy("qid", "rank").collect()]
    assert got == [("q", "p1", 1), ("q", "p2", 2), ("q", "p9", 3), ("r", "p5", 1)]


def test_one_hop_and_two(spark):
    e = spark.createDataFrame([("e1", "a", "b", "p", 0.9, "s1"), ("e2", "b", "c", "p", 0.8, "s1"), ("e3", "c", "d", "p", 0.7, "s2"), ("e4", "a", "a", "p", 0.1, "s2")], "id string, src string, dst string, predicate string, base_weight double, source_id string")
    s = spark.createDataFrame([("q", "a"), ("q", "a")], "qid string, id string")
    assert {r.id for r in graph.one_hop(s, e).collect()} == {"e1", "e4"}
    assert {r.id for r in graph.one_hop(s, e, cap=1).collect()} == {"e1"}
    assert {r.id for r in graph.one_hop(s, e, source_id="s2").collect()} == {"e4"}
    assert {r.id for r in graph.hops(s, e, 2).collect()} == {"e1", "e2", "e4"}
    assert graph.one_hop(s.where("false"), e).count() == 0


def _fold(bs):
    w = None
    for b in bs:
        w = b if w is None else (w + b) / 2
    return w


def _vote(axes):
    counts, cur = {}, None
    for a in axes:
        counts[a] = counts.get(a, 0) + 1
        cur = a if counts[a] == max(counts.values()) else max(counts, key=counts.get)
    return cur


def test_folds_equal_the_sequence(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        n = rnd.choice([1, 2, 5, 130])
        a = [(f"k{k}", i, rnd.choice(AXES[:3]), rnd.random(), rnd.choice([f"p{rnd.randrange(150)}", f"q{i}"]), f"s{i}") for i in range(n)]
        rows += a
        seen = []
        for x in a:
            if x[4] not in seen:
                seen.append(x[4])
        want[f"k{k}"] = (_fold([min(1, 0.5 + 0.5 * x[3]) for x in a]), _vote([x[2] for x in a]), seen[-100:], a[-1][5])
    d = spark.createDataFrame(rows, "key string, i int, axis string, confidence double, proposition_id string, source_id string").repartition(7)
    for r in graph.upsert_edges(d, ["key"], ["i"]).collect():
        w, axis, support, source = want[r.key]
        assert r.base_weight == pytest.approx(w, abs=1e-9) and r.axis == axis and r.support == support and r.source_id == source


def test_entity_upsert(spark):
    m = spark.createDataFrame([("Ann", "s1", 1), ("ann", "s2", 2), ("Bob", "s1", 3), (None, "s1", 4)], "name string, source_id string, i int")
    got = {r.name: (r.mention_count, r.source_id) for r in graph.upsert_entities(m, ["i"]).collect()}
    assert got == {"Ann": (1, "s2"), "Bob": (0, "s1")}
    old = spark.createDataFrame([("x", "ANN", "k", 4, "s0"), ("y", "Cid", "k", 0, "s0")], "id string, name string, kind string, mention_count long, source_id string")
    got = {r.id if len(r.id) == 1 else r.name: (r.name, r.mention_count, r.source_id) for r in graph.upsert_entities(m, ["i"], old).collect()}
    assert got == {"x": ("ANN", 6, "s2"), "y": ("Cid", 0, "s0"), "Bob": ("Bob", 0, "s1")}


def test_top_k_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 8)).round(2)
    v[10] = v[20]
    q = rng.standard_normal((5, 8))
    vec = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("bad", None), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [math.nan] * 8)], "id string, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "qid string, qvec array<double>")
    got = {(r.qid, r["rank"]): r.id for r in vectors.top_k(qs, vec, 7, 8).collect()}
    f = v.astype(np.float32).astype(float)
    d = np.round(1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (f / np.linalg.norm(f, axis=1)[:, None]).T, 9)
    for i in range(5):
        assert [got[f"q{i}", r + 1] for r in range(7)] == [f"v{j:03d}" for j in sorted(range(400), key=lambda j: (d[i, j], j))[:7]]
    assert vectors.top_k(qs, vec.where("false"), 3, 8).count() == 0


def test_buckets_move_no_vectors(spark):
    """What shares a bucket comes out as by definition, and only candidates are moved."""
    import re

    import numpy as np

    from strandweave.operators.buckets import bucket_top_k

    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((300, 8)).astype(np.float32).astype(float), rng.standard_normal((6, 8))
    vec = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("v007", v[7].tolist()), ("bad", None), ("zero", [0.0] * 8)], "id string, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("none", [0.0] * 8)], "qid string, qvec array<double>")
    found = bucket_top_k(qs, vec, 9, tables=2, bits=4, near=1, dim=8)
    planes = np.random.default_rng(5).standard_normal((2, 4, 8))
    want = set()
    for i, a in enumerate(q):
        near = []
        for j, b in enumerate(v):
            for p in planes:
                apart = np.flatnonzero((p @ a > 0) != (p @ b > 0))
                if not len(apart) or apart.tolist() == [np.argmin(np.abs(p @ a))]:
                    near.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 9), f"v{j:03d}"))
        want |= {(f"q{i}", x, r + 1) for r, (_, x) in enumerate(sorted(set(near))[:9])}
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search("Join", plan)


def test_backends(spark):
    with pytest.raises(ValueError):
        vectors.embed(spark.createDataFrame([("x",)], "t string"), "t", "v", provider="none")
    d = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [len(r.v) for r in vectors.embed(d, "t", "v", 16).collect()] == [16] * 3
    n = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vectors.normalised(F.col("v")).alias("n")).collect()
    assert n[0].n == pytest.approx([0.6, 0.8]) and n[1].n is None


def test_each_source_is_asked_alone(spark):
    """A large near source neither crowds out the seeds of a small one nor uses up its edges."""
    qs = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvec array<double>")
    rows = [(f"a{i}", [1.0, 0.01 * i], "big") for i in range(9)] + [("z1", [0.0, 1.0], "small"), ("z2", [0.1, 1.0], "small"), ("n", [1.0, 0.0], None)]
    seeds = vectors.top_k(qs, spark.createDataFrame(rows, "id string, embedding array<float>, source_id string"), 2, 2, scope="source_id")
    assert {(r.source_id, r.id, r["rank"]) for r in seeds.collect()} == {("big", "a0", 1), ("big", "a1", 2), ("small", "z2", 1), ("small", "z1", 2)}
    e = [(f"e{i}", "a0", "x", "p", 9.0, "big") for i in range(5)] + [("s1", "z1", "a0", "p", 0.1, "small"), ("s2", "x", "z2", "p", 0.2, "small"), ("s3", "a0", "y", "p", 9.0, "small")]
    e = spark.createDataFrame(e, "id string, src string, dst string, predicate string, base_weight double, source_id string")
    assert {(r.source_id, r.id) for r in graph.one_hop(seeds, e, cap=2, scoped=True).collect()} == {("big", "e0"), ("big", "e1"), ("small", "s1"), ("small", "s2")}
    assert {(r.source_id, r.id) for r in graph.hops(seeds, e, 2, cap=9, scoped=True).collect()} == {("big", f"e{i}") for i in range(5)} | {("small", f"s{i}") for i in (1, 2, 3)}
    pick = spark.createDataFrame([("q", "big", "p1"), ("q", "small", "p1")], "qid string, source_id string, pid string")
    p = spark.createDataFrame([("p1", "t", "d", "s", "small")], "id string, text string, source_doc string, source_span string, source_id string")
    assert [(r.source_id, r.text) for r in retrieve.fetch(pick, p, scoped=True).collect()] == [("small", "t")]
