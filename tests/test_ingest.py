import json

import pytest
from pyspark.sql import functions as F

from strandweave import config, pipeline
from strandweave.operators import answer, complete, evaluate, ingest, remote, vectors
from strandweave.sources import markdown
from strandweave.store import Store


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_hash_and_tokens(spark):
    r = spark.range(1).select(ingest.span_hash(F.lit("d"), F.lit("s"), F.lit("hello")).alias("h")).first()
    assert r.h == "3db9bd4ab215e5209866b7f342e532e0eaa987530831126ca3af2a1a8d8b067e"
    assert [one(spark, t, ingest.token_estimate) for t in ("", "ab", "x" * 9, None)] == [0, 1, 2, 0]
    assert one(spark, "src_abc", ingest.source_id) == "src_abc" and len(one(spark, "/a/b", ingest.source_id)) == 36


def test_sections():
    s = lambda t: list(markdown.sections(t))
    assert [p for p, _ in s("# T\n\n### A\nx\n\n### B\ny\n\n### C\nz")] == ["T / A", "T / A / B", "T / A / C"]
    assert [p for p, _ in s("### x\na\n### y\nb")] == ["x", "x / y"]
    assert s("T\n==\nbody") == [("T", "body")]
    assert s("# H\n\n```sql\nselect 1 # no heading\n```\n") == [("H", "select 1 # no heading")]
    assert s("# H\n\n<div>\nraw\n</div>\n\n- a\n- b\n\n    code") == [("H", "a\n\nb\n\ncode")]
    assert s("") == [] and s("# only\n\n## headings\n") == []


def test_walk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "sub" / "b.TXT").write_text("  text  ")
    (tmp_path / "c.py").write_text("x = 1")
    got = {(r.doc_id, r.section_path): r.text for r in markdown.walk(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "T"): "body", ("sub/b.TXT", ""): "text"}
    (tmp_path / "d.pdf").write_bytes(b"one\fb \f")
    got = markdown.walk(spark, str(tmp_path), lambda b: b.decode().split("\f")).where("doc_id = 'd.pdf'").collect()
    assert [(r.section_path, r.text) for r in got] == [("page-1", "one"), ("page-2", "b")]


def _pack(spans, most, overlap):
    out, cur, hs, tok = [], [], [], 0
    for t, h in spans:
        n = max(1, len(t) // 4)
        if cur and tok + n > most:
            out.append(("\n\n".join(cur), hs))
            tail = "\n\n".join(cur)[-4 * overlap :] if overlap else ""
            cur, hs, tok = ([tail], hs[-1:], max(1, len(tail) // 4)) if tail else ([], [], 0)
        cur, hs, tok = cur + [t], hs + [h], tok + n
    return out + ([("\n\n".join(cur), hs)] if cur else [])


def test_packing(spark):
    import random

    rnd = random.Random(5)
    sections = {(f"d{i % 5}", f"s{i}"): [("x" * rnd.choice([3, 40, 80, 400]), f"h{i}-{j}") for j in range(rnd.randrange(1, 12))] for i in range(40)}
    rows = [(d, s, j, t, h) for (d, s), v in sections.items() for j, (t, h) in enumerate(v)]
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows + [("e", "s", 0, None, "h"), ("e", "s", 1, "", "h")], "doc_id string, section_path string, span_no int, text string, hash string").repartition(3)
    for most, overlap in ((30, 5), (30, 0), (2, 5)):
        got = {}
        for r in ingest.pack(d, most, overlap).orderBy("doc_id", "section_path", "buffer_no").collect():
            got.setdefault((r.doc_id, r.section_path), []).append((r.text, r.span_hashes))
        assert got == {k: _pack(v, most, overlap) for k, v in sections.items()}


def test_ledger(spark):
    b = spark.createDataFrame([("b1", ["A", "b"]), ("b2", ["a", "c"]), ("b3", []), ("b4", None), ("b5", ["a", None])], "buffer_id string, span_hashes array<string>")
    led = spark.createDataFrame([("a",), ("B",)], "span_hash string")
    assert {r[0] for r in ingest.not_in_ledger(b, led).select("buffer_id").collect()} == {"b2", "b3", "b4", "b5"}
    new = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "span_hash string")
    assert [r[0] for r in ingest.ledger_insert(spark.createDataFrame([("a",)], "span_hash string"), new).collect()] == ["z"]


TRIPLE = {"subject": "a", "predicate": "b", "object": "c", "ontology_axis": "causal", "confidence": 0.5}
GOOD = {"propositions": [{"text": "t", "triples": [TRIPLE]}]}
PAYLOADS = [
    (json.dumps(GOOD), None),
    ("```json\n" + json.dumps(GOOD) + "\n```", None),
    ('{"propositions": []}', None),
    ("{}", "payload lacks propositions"),
    ("[]", "payload is not an object"),
    ("null", "payload is not an object"),
    ("{broken", "no valid JSON"),
    ("", "no valid JSON"),
    (json.dumps({"propositions": {}}), "propositions is no list"),
    (json.dumps({"propositions": [1]}), "proposition is not an object"),
    (json.dumps({"propositions": [{"text": "t"}]}), "proposition lacks a key"),
    (json.dumps({"propositions": [{"text": " ", "triples": []}]}), "text is blank or no string"),
    (json.dumps({"propositions": [{"text": 3, "triples": []}]}), "text is blank or no string"),
    (json.dumps({"propositions": [{"text": "t", "triples": {}}]}), "triples is no list"),
    *[(json.dumps({"propositions": [{"text": "t", "triples": [TRIPLE | c]}]}), why) for c, why in (({"confidence": True}, "confidence is not a number"), ({"confidence": "0.5"}, "confidence is not a number"), ({"confidence": 1.5}, "confidence is out of range"), ({"ontology_axis": "x"}, "unknown axis"), ({"confidence": 1}, None))],
    (json.dumps({"propositions": [{"text": "t", "triples": [{"subject": "a"}]}]}), "triple lacks a key"),
    (json.dumps({"propositions": [{"text": "t", "triples": [TRIPLE, 3]}]}), "triple is not an object"),
]


def test_validation(spark):
    d = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "i int, p string")
    got = {r.i: r.e for r in d.select("i", ingest.payload_error(F.col("p")).alias("e")).collect()}
    for i, (p, why) in enumerate(PAYLOADS):
        assert got[i] == why, p


def test_budget_and_prompts(spark):
    f = spark.createDataFrame([("q", 1, "a", "x" * 900, None, None), ("q", 2, "b", "y" * 10, "d", "s"), ("q", 3, "c", "z" * 2000, "d", "s"), ("q", 4, "e", "w", "d", "s")], "qid string, rank int, pid string, text string, source_doc string, source_span string")
    qs = spark.createDataFrame([("q", "why?"), ("r", "none?")], "qid string, question string")
    assert [r.pid for r in answer.within_budget(f, qs, 10).collect()] == ["a"]  # the first always stays
    assert sorted(r.pid for r in answer.within_budget(f, qs, 400).collect()) == ["a", "b"]  # and nothing behind the first overflow
    p = {r.qid: r for r in answer.answer_prompts(answer.within_budget(f, qs, 400), qs).collect()}
    assert p["q"].n_propositions == 2 and "[P2] (d#s) yyy" in p["q"].prompt and p["r"].prompt.startswith("I don't have information")


def test_citations(spark):
    a = spark.createDataFrame([("q", "yes [P1, P2; P3] and [P9] or [P1]", 3), ("n", "none", 3), ("z", None, 3)], "qid string, answer string, n_propositions int")
    assert [r.cited for r in answer.citations(a).orderBy("mark_no", "part_no").collect()] == [1, 2, 3, 1]


def test_metrics(spark):
    rows = [(["a#1", "b#2"], ["a#1", "c#3"], 0.5, 0.5), ([], [], 1.0, 1.0), (["a#1"], [], 1.0, 0.0), ([], ["a#1"], 0.0, 1.0), (["v.md#datatype"], ["v.md#Vectors in it / Datatype "], 1.0, 1.0), (["v#x"], ["w#x"], 0.0, 0.0), (["v"], ["v#"], 0.0, 0.0)]
    d = spark.createDataFrame([(g, p) for g, p, _, _ in rows], "g array<string>, p array<string>")
    p, r = evaluate.citation_scores(F.col("g"), F.col("p"))
    assert [tuple(x) for x in d.select(p, r).collect()] == [(a, b) for _, _, a, b in rows]
    assert [one(spark, t, evaluate.judge_score) for t in ("4", "**3**", "Score: 2.", "4/4", "7", "", None, "(3) 4")] == [4, 0, 2, 0, 0, 0, 0, 3]
    assert one(spark, ["a", "b", "b"], lambda c: evaluate.recall_at_k(c, F.array(F.lit("b"), F.lit("x"), F.lit("a")), 2), "array<string>") == 0.5


def test_training_examples(spark):
    e = spark.createDataFrame([("e1", "b", "c", "uses", "causal", ["p1", "p1"]), ("e2", "a", "c", "has", "temporal", ["p1"]), ("e3", "a", "b", None, None, ["p3"])], "id string, src string, dst string, predicate string, axis string, support array<string>")
    p = spark.createDataFrame([("p1", "text", "d", "s", "src"), ("p2", "y" * 59 + ". more", None, None, None), ("p3", None, "d", "", None)], "id string, text string, source_doc string, source_span string, source_id string")
    got = {r.id: r for r in answer.training_examples(answer.supporting_edges(p, e)).collect()}
    assert got["p1"].prompt.endswith("What does the corpus say about has?") and got["p1"].axes == ["causal", "temporal"] and got["p1"].predicates == ["has", "uses"]
    assert got["p2"].prompt == "State the fact: " + "y" * 59 + "..." and got["p2"].source == "#" and got["p2"].source_id == "default"
    assert got["p3"].prompt == "State the fact: " and got["p3"].predicates == []


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("rank:\n  top_m: 5\nretrieve:\n")
    c = config.load(str(f), {"STRANDWEAVE__RANK__TOP_M": "7", "strandweave__reweight__alpha": "2.5"})
    assert c.rank.top_m == 7 and c.reweight.alpha == 2.5 and c.retrieve.seed_k_entities == 8
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))


def test_store_is_idempotent_and_merges(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.init()
    s.init()
    assert "ledger" in s.tables() and s.read("axis").count() == 5
    ddl = "unit_id string, source_id string, doc_id string, section_path string, span_hashes array<string>, propositions array<struct<text:string,triples:array<struct<subject:string,predicate:string,object:string,ontology_axis:string,confidence:double>>>>, received_at timestamp"
    unit = lambda i, c: spark.createDataFrame([(f"u{i}", "s", "d", "p", [f"H{i}"], [("t", [("A", "r", "B", "causal", c), ("A", "r", "C", "no axis", c)]), ("alone", None)], None)], ddl)
    span = lambda i: spark.createDataFrame([(f"H{i}", "d", "p")], "hash string, doc_id string, section_path string")
    s.ingest(unit(1, 0.9), span(1))
    born = {r.name: r.created_at for r in s.read("entity").collect()}
    for _ in range(2):  # the second time nothing is new
        s.ingest(unit(2, 0.5), span(2))
        rel = s.read("rel").collect()
        assert len(rel) == 1 and rel[0].base_weight == pytest.approx(0.85) and rel[0].n_assertions == 2 and rel[0].axis_counts == {"causal": 2}
        assert s.read("ledger").count() == 2 and {r.text for r in s.read("proposition").collect()} == {"t", "alone"}
        ent = {r.name: r for r in s.read("entity").collect()}
        assert {n: r.mention_count for n, r in ent.items()} == {"A": 1, "B": 1} and {n: r.created_at for n, r in ent.items()} == born
        assert all(len(r.embedding) == 64 for r in ent.values()) and {rel[0].src, rel[0].dst} == {r.id for r in ent.values()}
    assert [r[0] for r in s.sources().collect()] == ["s"]
    s.clear_ledger()
    assert s.read("ledger").count() == 0 and s.read("entity").count() == 2
    s.init(rebuild=True)
    assert s.read("entity").count() == 0


def test_store_takes_single_rows_and_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    e = lambda *r: s.add_entities(spark.createDataFrame(list(r), "seq int, name string, kind string, embedding array<float>, source_id string"))
    e((1, "Ab", "tool", [1.0, 0.0], "s"))
    e((1, "aB", "other", [0.0, 1.0], "t"), (2, None, None, None, None), (3, "c", None, None, "t"), (4, "C", "x", [2.0], None))
    got = {r.name: r for r in s.read("entity").collect()}
    assert set(got) == {"Ab", "c"} and (got["Ab"].kind, got["Ab"].mention_count, got["Ab"].source_id, got["Ab"].embedding) == ("tool", 1, "t", [0.0, 1.0])
    assert (got["c"].kind, got["c"].mention_count, got["c"].source_id, got["c"].embedding) == (None, 1, None, [2.0])
    p = spark.createDataFrame([(1, "x", "d", None, None, "s"), (1, "x", "d", None, None, "s"), (2, None, "d", None, None, "s")], "seq int, text string, source_doc string, source_span string, embedding array<float>, source_id string")
    for _ in range(2):
        s.add_propositions(p)
        assert [r.text for r in s.read("proposition").collect()] == ["x"]
    r = lambda *x: s.add_edges(spark.createDataFrame(list(x), "seq int, src string, dst string, predicate string, axis string, base_weight double, proposition_id string, source_id string"))
    r((1, "a", "b", "r", "causal", 0.8, "p1", "s"))
    r((1, "a", "b", "r", "temporal", 0.6, "p2", "t"), (2, "a", "b", "r", "temporal", 0.9, None, "t"), (3, "a", None, "r", "causal", 0.5, None, "t"))
    (got,) = s.read("rel").collect()
    assert got.base_weight == pytest.approx(((0.8 + 0.6) / 2 + 0.9) / 2) and got.support == ["p1", "p2"] and got.axis == "temporal" and got.axis_counts == {"causal": 1, "temporal": 2}
    led = spark.createDataFrame([("H", "d", "p"), ("h", "d", "p"), (None, "d", "p")], "span_hash string, doc_id string, section_path string")
    for _ in range(2):
        s.add_to_ledger(led)
        assert [x.span_hash for x in s.read("ledger").collect()] == ["h"]


def test_a_local_model_is_loaded_once_a_task(spark):
    class Model:
        def __init__(self, name):
            self.n = len(name)

        def encode(self, texts):
            return [[self.n, len(t)] for t in texts]

    vectors.register_backend("here", vectors.local_model("abc", Model))
    d = spark.createDataFrame([("xy",), (None,)], "t string")
    assert sorted(list(r.v) for r in vectors.embed(d, "t", "v", 2, "here").collect()) == [[3.0, 0.0], [3.0, 2.0]]
    with pytest.raises(Exception, match="gives 2 numbers, not 64"):
        vectors.embed(d, "t", "v", 64, "here").collect()


def test_positions_beyond_an_int(spark):
    t = spark.createDataFrame([("u", 5000, 1, "A", "B"), ("u", 1, 2_000_000, "B", "C")], "unit_id string, prop_no int, triple_no int, subject string, object string")
    got = {r.surface: tuple(r.first_pos) for r in ingest.surfaces(t).collect()}
    assert got == {"A": (5000, 1, 0), "B": (1, 2_000_000, 0), "C": (1, 2_000_000, 1)}


def test_completions_are_tried_again_and_fall_back(spark):
    def broken():
        def f(prompts):
            raise RuntimeError("down")

        return f

    def once():  # fails on its first call
        calls = []

        def f(prompts):
            calls.append(1)
            if len(calls) == 1:
                raise TimeoutError("busy")
            return [p.upper() for p in prompts]

        return f

    complete.register_backend("broken", broken)
    complete.register_backend("once", once)
    d = spark.createDataFrame([("a",), (None,), ("b",)], "p string").coalesce(1)
    rows = lambda *a, **k: [tuple(r) for r in complete.complete(d, "p", "out", *a, **k).collect()]
    assert rows("once") == [("a", "A", None), (None, None, None), ("b", "B", None)]
    assert rows("broken", "once", wait=0.01)[0] == ("a", "A", None)
    assert rows("broken", wait=0.01)[0] == ("a", None, "RuntimeError: down")
    with pytest.raises(ValueError):
        complete.complete(d, "p", "out", "none")


def test_models_behind_http(spark):
    """A task's requests go through what is given to send with; the reply's text and numbers are read where the path says."""

    def send(url, body, timeout):
        if "prompt" in body:
            return {"data": [{"embedding": [float(len(body["prompt"])), 1.0]}]}
        if body["messages"][-1]["content"] == "bad":
            raise OSError("refused")
        return {"message": {"content": f"{url} {body['model']} {body['format']} {len(body['messages'])} {body['messages'][-1]['content']}"}}

    vectors.register_backend("far", remote.embeddings("http://e", "m", path="data.0.embedding", send=send))
    complete.register_backend("far", remote.completions("http://c", "m", system="be brief", extra={"format": "json"}, send=send))
    d = spark.createDataFrame([("abc",), (None,)], "t string").coalesce(1)
    assert [list(r.v) for r in vectors.embed(d, "t", "v", 2, "far").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="gives 2 numbers, not 64"):
        vectors.embed(d, "t", "v", 64, "far").collect()
    assert complete.complete(d, "t", "out", "far").first().out == "http://c m json 2 abc"
    one = complete.complete(spark.createDataFrame([("bad",)], "t string"), "t", "out", "far", wait=0.01).first()
    assert (one.out, one.out_error) == (None, "OSError: refused")
    assert remote.pick({"a": [{"b": 3}]}, "a.0.b") == 3


def test_systems_are_parsed():
    assert pipeline.systems(" graph, ,nearest,graph ") == ["graph", "nearest"]
    for bad in ("", " , ", "graph,other"):
        with pytest.raises(ValueError):
            pipeline.systems(bad)


def test_extraction_repairs_once(spark):
    def stubborn():
        def f(prompts):
            good = json.dumps(GOOD)
            return [good if "fine" in p or ("mend" in p and complete.REPAIR in p) else "{broken" for p in prompts]

        return f

    complete.register_backend("stubborn", stubborn)
    b = spark.createDataFrame([("1", "fine"), ("2", "mend"), ("3", "never")], "unit_id string, text string")
    good, bad = complete.extract(b, "stubborn")
    assert {r.unit_id for r in good.collect()} == {"1", "2"}
    assert [(r.unit_id, r.error_type, r.error_message) for r in bad.collect()] == [("3", "validation", "no valid JSON")]


def test_folder_to_answer(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Index\n\nVectors cause faster search. A partition is a kind of segment.\n")
    (tmp_path / "docs" / "b.txt").write_text("Backups run before upgrades.")
    s = Store(spark, str(tmp_path / "store"))
    s.init()
    one = pipeline.ingest_folder(s, str(tmp_path / "docs"), "src_x", config.Config())
    assert one == {"spans": 2, "buffers": 2, "skipped": 0, "extracted": 2, "refused": 0}
    n = {t: s.read(t).count() for t in ("entity", "proposition", "rel", "ledger", "mentions")}
    assert n["proposition"] == 3 and n["rel"] == 3 and n["ledger"] == 2
    two = pipeline.ingest_folder(s, str(tmp_path / "docs"), "src_x", config.Config())
    assert two["skipped"] == 2 and {t: s.read(t).count() for t in n} == n
    q = spark.createDataFrame([("q", "Vectors search")], "qid string, question string")
    r = pipeline.ask(s, q, "src_x").first()
    assert r.answer.startswith("It is stated in [P1]") and len(r.evidence) == len(r.cited) > 0
    assert pipeline.ask(s, q, "src_other").first().answer.startswith("I don't have information")
