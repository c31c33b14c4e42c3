import random
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from strandweave.llm import catalog, incremental, neighbours
from strandweave.llm.incremental import WordHashes
from strandweave.session import shared_dir

# ---------------------------------------------------------------- 2


def _vectors(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dim))
    x = np.concatenate([centres[rng.integers(len(centres), size=n // 2)] + 0.25 * rng.standard_normal((n // 2, dim)), rng.standard_normal((n - n // 2, dim))])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).round(4)


def _nearest(x, k, floor):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        s = x @ x[i]
        s[i] = -9
        out |= {(i, j) for j in sorted(np.argpartition(-s, k + 2)[: k + 3], key=lambda j: (-round(s[j], 7), j))[:k] if s[j] >= floor}
    return out


def test_forest_recall_in_one_leaf():
    x = _vectors(1, 9000)
    q, r, s = neighbours.forest_neighbours(neighbours._codes(x), 5, 0.8)
    want = _nearest(x, 5, 0.8)
    got = set(zip(q.tolist(), r.tolist()))
    assert len(got & want) / len(want) > 0.97 and (s >= 0.8).all()


def test_recall_over_many_leaves(spark):
    x = _vectors(2, 6000)
    d = spark.createDataFrame([(f"{i:032x}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    got = {(int(r.id_a, 16), int(r.id_b, 16)) for r in neighbours.similar_pairs({"t": d}, 0.8, leaf_rows=500).collect()}
    want = {(min(p), max(p)) for p in _nearest(x, 5, 0.8)}
    assert len(got & want) / len(want) > 0.95 and len(got - want) / len(got) < 0.05


def test_leaves_beyond_what_the_driver_fits(spark):
    """A sample of 100 gives two levels on the driver; the others are fitted in tasks."""
    x = _vectors(4, 4000)
    d = spark.createDataFrame([(f"{i:032x}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    w, t = neighbours._routes_of(d, "t", 64, 250, sample=100)
    assert len(t) == 15 and (np.linalg.norm(w, axis=1) > 0.99).all()
    _, leaf = neighbours.routes(neighbours._unit(neighbours._codes(x)), w, t, np.zeros(len(x)), 1)
    assert np.bincount(leaf, minlength=16).max() < 700
    got = {(int(r.id_a, 16), int(r.id_b, 16)) for r in neighbours.similar_pairs({"t": d}, 0.8, leaf_rows=250, sample=100).collect()}
    want = {(min(p), max(p)) for p in _nearest(x, 5, 0.8)}
    assert len(got & want) / len(want) > 0.93


def test_weak_neighbours_of_a_query_set(spark):
    """The ids divisible by 100 against all rows, without a floor, at production settings over several leaves."""
    x = np.random.default_rng(6).standard_normal((6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(4)
    d = spark.createDataFrame([(f"{i:032x}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    rows = neighbours.neighbours({"t": d}, asks=catalog.every_hundredth, leaf_rows=800, **neighbours.THOROUGH)
    got = {(int(bytes(r.id)[1:].hex(), 16), int(bytes(r.neighbour)[1:].hex(), 16)) for r in rows.collect()}
    want = {(i, j) for i, j in _nearest(x, 5, -1) if i % 100 == 0}
    assert {i for i, _ in got} == set(range(0, 6000, 100)) and len(got) == 300
    assert len(got & want) / len(want) >= 0.9


def test_copies_and_unusable_vectors(spark):
    x = _vectors(3, 40)
    rows = [(f"v{i:02d}", x[i].tolist(), 0) for i in range(40)]
    rows += [(f"c{i:02d}", x[0].tolist(), 0) for i in range(12)] + [("d1", (x[1] * 3).tolist(), 0), ("v02", x[2].tolist(), 0)]
    rows += [("n1", None, 0), ("n2", [1.0] * 63, 0), ("n3", [0.0] * 64, 0), ("n4", [float("nan")] * 64, 0), ("n5", [None] * 64, 0), (None, x[5].tolist(), 0)]
    d = spark.createDataFrame(rows, "id string, embedding array<float>, similarity int")
    n = {}
    for r in neighbours.neighbours({"t": d.select("id", "embedding")}).collect():
        n.setdefault(bytes(r.id), []).append((bytes(r.neighbour), r.similarity))
    name = lambda b: b[1:].decode()
    got = {name(k): sorted(name(a) for a, _ in v) for k, v in n.items()}
    assert set(got) == {r[0] for r in rows if r[0] and not r[0].startswith("n")} and all(len(v) == 5 for v in got.values())
    copies = sorted([f"c{i:02d}" for i in range(12)] + ["v00"])
    for c in copies:
        assert got[c] == [m for m in copies if m != c][:5]
    assert "d1" in got["v01"] and "v01" in got["d1"]
    assert neighbours.neighbours({"t": d.where("false").select("id", "embedding")}).count() == 0


# ---------------------------------------------------------------- 5


def test_edit_distance():
    rnd = random.Random(1)

    def brute(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    for _ in range(600):
        a = [rnd.choice("abcd") for _ in range(rnd.randrange(14))]
        b = [x for x in a if rnd.random() < 0.8] + [rnd.choice("abcd") for _ in range(rnd.randrange(3))]
        for most in (0, 2, 20):
            assert incremental.edit_distance(a, b, most) == min(brute(a, b), most + 1)


def _batches(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)]
    spans, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = list(rnd.choice(texts[-40:]))
            for _ in range(rnd.randrange(1 + len(w) // 6)):
                op = rnd.random()
                at = rnd.randrange(len(w)) if w else 0
                if op < 0.4 and w:
                    w[at] = rnd.choice(vocab)
                elif op < 0.7 and w:
                    del w[at]
                else:
                    w.insert(at, rnd.choice(vocab))
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 6, 7, 8, 9, 16, 24, 40]))]
        texts.append(w)
        t = None if rnd.random() < 0.02 else rnd.choice([" ", ", "]).join(w)
        spans.append((f"s{i:05d}", f"d{i % 7}", "p", t.upper() if t and rnd.random() < 0.2 else t, rnd.choice([None, f"h{i}", f"H{max(0, i - 9)}"]), i * 6 // n))
    spans += spans[:15] + [(None, "d", "p", "x", None, 0)]
    pool = [f"{i:04x}" for i in range(60)]
    bufs, sets = [], []
    for i in range(n // 2):
        s = rnd.sample(pool, rnd.randrange(9)) if not sets or rnd.random() < 0.5 else list(rnd.choice(sets))
        if s and rnd.random() < 0.4:
            s[rnd.randrange(len(s))] = rnd.choice(pool)
        sets.append(s)
        bufs.append((f"b{i:05d}", "d", "p", [x.upper() if rnd.random() < 0.3 else x for x in s] + ([None] if rnd.random() < 0.2 else []), i * 6 // (n // 2)))
    return spans, bufs


def _greedy(spans, bufs):
    out = set()
    seen, acc = set(), []
    for i, _, _, t, h, b in sorted([s for s in spans if s[0]], key=lambda s: (s[5], s[0])):
        if i in seen:
            continue
        seen.add(i)
        w, h = None if t is None else t.lower().replace(",", "").split(), h and h.lower()
        for j, v, g in acc:
            most = max(len(w or []), len(v or [])) // 8
            if (h and h == g) or (w is not None and v is not None and incremental.edit_distance(w, v, most) <= most):
                out.add(("span", j, i))
                break
        else:
            acc.append((i, w, h))
    acc = []
    for i, _, _, s, b in sorted(bufs, key=lambda s: (s[4], s[0])):
        x = {v.lower() for v in s if v}
        for j, y in acc:
            if x and 4 * len(x & y) >= 3 * len(x | y):
                out.add(("buffer", j, i))
                break
        else:
            acc.append((i, x))
    return out


SPAN = "span_id string, doc_id string, section_path string, text string, hash string, batch_no int"
BUFFER = "buffer_id string, doc_id string, section_path string, span_hashes array<string>, batch_no int"


def _found(spark, spans, bufs, **kw):
    s = spark.createDataFrame(spans, SPAN).withColumns({"unit": F.lit(1), "node": F.lit("x")})
    rows = incremental.link_batches(s, spark.createDataFrame(bufs, BUFFER), **kw).collect()
    got = {(r.unit, r.first_id, r.dup_id) for r in rows}
    assert len(got) == len(rows)
    return got


def test_linkage_is_the_greedy_one(spark):
    spans, bufs = _batches(11)
    assert _found(spark, spans, bufs) == _greedy(spans, bufs)


def test_steps_do_not_change_the_result(spark):
    spans, bufs = _batches(12, 120)
    want = _greedy(spans, bufs)
    for cuts in ([], [2, 4], [1, 2, 3, 4, 5]):
        assert _found(spark, spans, bufs, cuts=cuts) == want


def test_each_batch_by_a_linker_of_its_own(spark, tmp_path):
    """State is left below a path and loaded again; a small batch opens few of its buckets; a step that is run again gives the same; hashes that other texts carry count."""
    spans, bufs = _batches(13, 90)
    s, b = spark.createDataFrame(spans, SPAN), spark.createDataFrame(bufs, BUFFER)
    u = incremental.units(s, b).cache()
    path, got = str(tmp_path / "state"), set()
    for n in range(6):
        link = incremental.Linker(spark, path, buckets=64, hot=64)
        new = {(r.unit, r.first.id, r.ord.id) for r in link.step(u.where(F.col("batch_no") == n)).collect()}
        assert link.n > n
        got |= new
    assert got == _greedy(spans, bufs)
    again = incremental.Linker(spark, path, buckets=64).step(u.where("batch_no = 5"))
    assert {(r.unit, r.first.id, r.ord.id) for r in again.collect()} == new
    one = u.where("ord.id = 's00089'")
    link = incremental.Linker(spark, path, buckets=64)
    assert len(link._apart(one)[2]) <= 2


def test_batch_numbers_of_any_size(spark):
    rows = [("b", "d", "p", "one two three four", None, 1764313299), ("a", "d", "p", "one two three four", None, 1764313300), ("c", "d", "p", "one two three four", None, -7), ("e", "d", "p", None, None, None)]
    assert _found(spark, rows, [], cuts=[0]) == {("span", "c", "a"), ("span", "c", "b")}


def test_near_copies_on_most_rows_are_not_paired_with_each_other(spark, tmp_path):
    """A hot key: later near-copies meet the first of them, in further rounds."""
    base = [f"w{i}" for i in range(40)]
    rows = [(f"s{i:05d}", "d", "p", " ".join(base[:20] + [f"n{i}"] + base[20:]), None, 0) for i in range(1500)]
    rows += [(f"t{i:05d}", "d", "p", " ".join(f"u{i}x{j}" for j in range(20)), None, 0) for i in range(100)]
    u = incremental.units(spark.createDataFrame(rows, SPAN), spark.createDataFrame([], BUFFER))
    link = incremental.Linker(spark, str(tmp_path / "hot"), hot=128)
    got = {(r.first.id, r.ord.id) for r in link.step(u).collect()}
    assert got == {("s00000", f"s{i:05d}") for i in range(1, 1500)} and link.n >= 2


def test_one_text_on_most_rows_and_empty_tables(spark):
    spans = [(f"s{i:04d}", f"d{i}", "p", "the same text of a few words here" if i % 3 else f"text number {i} " * 4, None, i // 300) for i in range(900)]
    got = _found(spark, spans, [])
    assert len([g for g in got if g[1] == "s0001"]) == 599
    assert _found(spark, [], []) == set()


def test_true_pairs_unlike_those_of_the_first_batch_are_found(spark):
    """The first batch holds close copies and near misses; the later one edits the rarest words, spread evenly over the text."""
    spans = []

    def add(words, batch):
        spans.append((f"s{len(spans):05d}", "d", "p", " ".join(words), None, batch))

    def edited(words, at, tag):
        return [f"{tag}x{i}" if i in at else w for i, w in enumerate(words)]

    rare = range(4, 72, 8)
    bases = [[f"f{f}r{i}" if i in rare else f"f{f}w{i}" for i in range(72)] for f in range(60)]
    for f, base in enumerate(bases):
        add(base, 0)
        add(edited(base, [71], f"f{f}c"), 0)
        for m in range(3):
            add(edited(base, [*rare, m], f"f{f}m{m}"), 0)
    for f, base in enumerate(bases):
        add(edited(base, rare, f"f{f}late"), 1)
    want = _greedy(spans, [])
    assert len([w for w in want if w[2] >= "s00300"]) == 60
    assert _found(spark, spans, []) == want


def test_what_tells_nodes_in_pairs_does_not_grow_with_them(spark, tmp_path):
    """Node slots go to the tasks as a bit map: many nodes, few rows to broadcast."""
    link = incremental.Linker(spark, str(tmp_path / "met"))
    nodes = spark.range(-3000, 60_000).select(F.col("id").alias("node"))
    pairs = spark.range(-64, 6400).select(F.col("id").alias("a"))
    met = link._met(nodes, pairs, "a")
    assert sorted(r.node for r in met.collect()) == list(range(-64, 6400))
    assert "bit_or" in met._jdf.queryExecution().optimizedPlan().toString()


def test_a_step_leaves_its_state_and_result_only(spark, tmp_path):
    """Tables of a step that has ended take no disk during later ones, and the result can still be read."""
    spans, bufs = _batches(14, 90)
    u = incremental.units(spark.createDataFrame(spans, SPAN), spark.createDataFrame(bufs, BUFFER))
    at = Path(shared_dir(spark).removeprefix("file://"))
    before = set(at.iterdir())
    got = incremental.Linker(spark, str(tmp_path / "state")).step(u)
    left = {p for p in set(at.iterdir()) - before if list(p.rglob("*.parquet"))}
    assert {p.name.split("-")[0] for p in left} == {"found"} and len(left) == 1
    assert {(r.unit, r.first.id, r.ord.id) for r in got.collect()} == _greedy(spans, bufs)


def test_a_text_is_hashed_once_for_keys_of_all_eras_and_signature():
    class Counted(WordHashes):
        def __init__(self):
            super().__init__()
            plain, self.calls = self.hash, 0
            self.hash = lambda w: (setattr(self, "calls", self.calls + 1), plain(w))[1]

    rnd, known = random.Random(3), Counted()
    texts = [" ".join(f"w{rnd.randrange(30)}" for _ in range(n)) for n in (0, 1, 2, 3, 9, 40, 40)] + [" ".join(f"{x:04x}" for x in range(n)) for n in (1, 8)]
    kinds = ["span"] * 7 + ["buffer"] * 2
    row, key, take, n, sign = incremental.grams(kinds, texts, known)
    sketches = [np.array([rnd.randrange(60) for _ in range(1 << 10)], np.uint8) for _ in range(2)]
    made = [incremental.blocking_keys(row, key, take, s) for s in sketches]
    assert known.calls <= 30 + 3 + 9  # words, texts too short for a gram, elements
    for s, (r, k, need) in zip(sketches, made):
        for i, (kind, t) in enumerate(zip(kinds, texts)):
            w = t.split()
            p = len(w) - -(-3 * len(w) // 4) + 1 if kind == "buffer" else 1 if len(w) < 3 else 3 * (len(w) // 7) + 1
            every = sorted({int(x) for x in key[row == i]}, key=lambda x: (s[x % len(s)], x))
            assert list(k[r == i]) == every[: p + 2] and need[i] == min(3, max(1, len(every) - p + 1)) and n[i] == len(w)
            bits = reduce(int.__xor__, [1 << (WordHashes()[x] % incremental.SIGNATURE_BITS) for x in w], 0)
            assert int(sign[i]) == bits
    assert [int((row == i).sum()) for i in range(9)] == [1, 1, 1, 1, 7, 38, 38, 1, 8]
