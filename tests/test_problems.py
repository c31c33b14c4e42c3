import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandweave.operators.nested import shared_types, schema_graph, shred
from strandweave.operators.orphans import Parent, Reference, orphan_counts, orphans
from strandweave.operators.units import units_from_payloads


def test_shredding_keeps_keys_and_counts(spark):
    ddl = "id string, a struct<b:int,c:struct<d:string>>, a_b int, l array<struct<x:int,m:array<string>,pos_1:int>>, l2 array<struct<x:int,m:array<string>,pos_1:int>>, k map<string,int>, deep array<array<int>>"
    rows = [
        ("r1", (1, ("s",)), 9, [(1, ["p", None], 7), None, (2, None, 7)], [(3, [], 7)], {"u": 1, "v": None}, [[1], None, [2, 3]]),
        ("r1", (1, ("s",)), 9, [(1, ["p", None], 7), None, (2, None, 7)], [(3, [], 7)], {"u": 1, "v": None}, [[1], None, [2, 3]]),
        ("r2", None, None, None, [], None, []),
        (None, None, None, None, None, None, None),
    ]
    t = shred(spark.createDataFrame(rows, ddl), "id", "root")
    root = {r.id: r for r in t["root"].collect()}
    assert set(root) == {"r1", "r2"} and root["r1"].a_b == 1 and root["r1"].a_b_2 == 9 and root["r1"].a_c_d == "s"
    assert root["r1"].n_l == 2 and root["r2"].n_l == 0
    kids = sorted((r.id, r.parent_table, r.pos_1, r.x, r.n_m) for r in t["root__l"].collect())  # l and l2 share a table
    assert kids == [("r1", "root", 1, 1, 1), ("r1", "root", 1, 3, 0), ("r1", "root", 3, 2, 0)]
    assert sorted((r.pos_1, r.pos_2, r.value) for r in t["root__l__m"].collect()) == [(1, 1, "p")]
    assert [(r.entry_key, r.value) for r in t["root__k"].collect()] == [("u", 1)]
    assert sorted((r.pos_1, r.pos_2, r.value) for r in t["root__deep__item"].collect()) == [(1, 1, 1), (3, 1, 2), (3, 2, 3)]


def test_shredding_an_empty_table(spark):
    t = shred(spark.createDataFrame([], "id string, l array<struct<x:int>>"), "id", "r")
    assert t["r"].count() == 0 and t["r__l"].count() == 0


def test_payload_wrappings(spark):
    u = {"propositions": [None, {"text": "t", "triples": [None, {"subject": "s", "confidence": "0.5", "extra": 1}]}, {"text": "v"}]}
    j = json.dumps(u)
    cases = {
        "plain": j, "fence": f"```json\n{j}\n```", "quoted": json.dumps(j), "outer": json.dumps({"data": u}), "both": json.dumps(f"```\n{json.dumps({'unit': u})}\n```"),
        "single": json.dumps({"propositions": {"text": "t", "triples": {"subject": "s"}}}), "cut": j[:-3], "list": "[]", "null": "null", "empty": "", "behind": j + " x", "none": None,
        "deep": json.dumps(json.dumps(f"```\n{json.dumps('```json' + chr(10) + j + chr(10) + '```')}\n```")), "nested": json.dumps({"a": {"b": {"c": u}}}),
        "scalar": json.dumps({"propositions": "x", "more": 1}), "odd": json.dumps({"propositions": ["text", 3], "doc_id": 5}), "bare": "{}",
    }
    d = spark.createDataFrame([(k, v) for k, v in cases.items()], "unit_id string, payload string").withColumns({"source_id": F.lit("s"), "received_at": F.current_timestamp()})
    got = {r.unit_id: r.propositions for r in units_from_payloads(d).collect()}
    assert set(got) == {"plain", "fence", "quoted", "outer", "both", "deep", "nested", "single", "scalar", "odd", "bare"}
    for k in ("plain", "fence", "quoted", "outer", "both", "deep", "nested"):
        assert got[k][0] is None and got[k][1].triples[0] is None and got[k][1].triples[1].subject == "s" and got[k][1].triples[1].confidence == 0.5 and got[k][2].triples is None
    assert got["single"][0].triples[0].subject == "s" and got["scalar"] is None and got["bare"] is None
    assert got["odd"][0].text == "text" and got["odd"][1].triples is None


def test_orphans_against_brute_force(spark):
    rnd = random.Random(2)
    t0 = datetime(2025, 1, 1)
    at = lambda: t0 + timedelta(days=rnd.randrange(100))
    parents = [(f"k{rnd.randrange(40)}", rnd.choice([None, None, None, at()]), at()) for _ in range(60)]
    refs = [(f"r{i}", rnd.choice(["k0", f"k{rnd.randrange(60)}", None]), at()) for i in range(500)]
    refs += refs[:20]
    p = spark.createDataFrame(parents, "id string, deleted_at timestamp, created_at timestamp")
    r = spark.createDataFrame(refs, "rid string, target string, t timestamp")
    got = orphans([Parent("p", p, F.col("id"), F.col("deleted_at"), F.col("created_at"))], [Reference("c", "target", "p", r, F.col("rid"), F.col("target"), F.col("t"), F.col("t"))])
    want = set()
    for rid, k, t in refs:
        own = [x for x in parents if x[0] == k]
        if k and (not own or any(x[1] for x in own) or min(x[2] for x in own) > t):
            want.add((rid, k))
    rows = got.collect()
    assert {(x.row_id, x.target_id) for x in rows} == want and len(rows) == len(want)
    assert sum(x.n_orphans for x in orphan_counts(got).collect()) == len(want)
    none = orphans([Parent("p", p.where("false"), F.col("id"), F.col("deleted_at"), F.col("created_at"))], [Reference("c", "target", "p", r, F.col("rid"), F.col("target"), F.col("t"), F.col("t"))])
    assert none.count() == len({(a, b) for a, b, _ in refs if b})
    assert orphans([Parent("p", p, F.col("id"), F.col("deleted_at"), F.col("created_at"))], [Reference("c", "target", "p", r.where("false"), F.col("rid"), F.col("target"), F.col("t"), F.col("t"))]).count() == 0
