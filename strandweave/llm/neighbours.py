"""Problem 2: the most similar vectors for every vector.

A forest of random-projection trees, searched through a queue that all trees share, with exact reranking.

1. Each usable vector becomes a unit vector in 16-bit numbers (two bytes a coordinate); equal codes are copies and are
   grouped first, so copies cost one row however many there are.
2. The upper levels of the forest route every vector to one leaf of about `leaf_rows` rows, and to the leaves behind planes that it is closest
   to: the queue's order is the margin, at most `most_routes` leaves in all. There are as many levels as the number of vectors asks for: the first
   ones are fitted on the driver, on `SAMPLE` vectors a table, the further ones in tasks, on about `PER_LEAF` vectors for each
   leaf. Only the planes are collected and broadcast: 260 bytes for each leaf of 64 numbers, at most `MAX_LEVELS` levels (2.6 billion vectors a table at
   the default leaf; more is an error, and a larger leaf the answer).
3. Within each such leaf a forest is grown; every vector visits its own leaf in each tree and then the `visits` leaves with the smallest margins
   over all trees. Candidates are reranked by exact integer dot products; lists from several leaves are merged.

Every vector is indexed. Every vector is a query, or with `asks` those whose id it accepts; then the others lie in their own leaf only, and queries go to
every leaf within the margin. Cases: null vectors, other sizes, null / NaN / infinite numbers and all-zero
vectors are not usable and take no part; null ids neither; rows that repeat an id and vector are one; ties in similarity go to the
smaller id; copies are each other's first neighbours; an empty table gives no row; only id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import materialise

SAMPLE = 20_000
PER_LEAF = 32
MAX_LEVELS = 18
SCALE = 32_767
# For neighbours that are hardly nearer than others: queries go to most leaves and look at most of what lies there.
THOROUGH = {"margin": 0.2, "most_routes": 1 << MAX_LEVELS, "forest": {"trees": 3, "leaf": 512, "visits": 24, "aside": 0.6}}


def pack_id(c: Column) -> Column:
    """A text id as bytes; 32 lower-case hex digits take 17 bytes."""
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpack_id(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.hex(F.substring(c, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def _codes(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * SCALE).astype("<i2")


def _usable_codes(emb: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable vectors, their codes)."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(emb), dim), False).to_numpy(zero_copy_only=False)
    x = emb.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ok = ok.copy()
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, _codes(x[good]) if good.any() else np.zeros((0, dim), "<i2")


def encode(df: DataFrame, dim: int) -> DataFrame:
    """(tbl, id, embedding) -> (tbl, id, code) for the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, code = _usable_codes(b.column("embedding"), dim)
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("tbl"), kept.column("id"), pa.array([r.tobytes() for r in code], pa.binary())], ["tbl", "id", "code"])

    return df.select("tbl", "id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, "tbl string, id binary, code binary")


def _unit(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _plane(x: np.ndarray, rng: np.random.Generator, tries: int) -> tuple[np.ndarray, float]:
    """Between two points each, the plane at the median with the fewest points beside it."""
    best = None
    for _ in range(tries):
        p, q = rng.integers(len(x), size=2)
        w = x[p] - x[q]
        norm = float(np.linalg.norm(w))
        if norm < 1e-6:
            continue
        w = w / norm
        s = x @ w
        t = float(np.median(s))
        near = float((np.abs(s - t) < 0.04).mean())
        if best is None or near < best[0]:
            best = (near, w, t)
    if best is None:
        w = rng.standard_normal(x.shape[1]).astype(np.float32)
        w /= np.linalg.norm(w)
        return w, float(np.median(x @ w))
    return best[1], best[2]


def fit_routes(sample: np.ndarray, levels: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Planes of a full binary tree: normals [2^levels - 1, dim] and thresholds."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    w, t = np.zeros((2**levels - 1, dim), np.float32), np.zeros(2**levels - 1, np.float32)
    parts = {0: sample}
    for node in range(2**levels - 1):
        x = parts.pop(node)
        if len(x) < 4:
            x = sample
        w[node], t[node] = _plane(x, rng, 24)
        left = x @ w[node] <= t[node]
        parts[2 * node + 1], parts[2 * node + 2] = x[left], x[~left]
    return w, t


def routes(x: np.ndarray, w: np.ndarray, t: np.ndarray, margin: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): each row's own leaf, and those behind planes nearer than the row's margin, nearest first, at most `most` in all."""
    rows, node, pri = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for _ in range(int(math.log2(len(t) + 1)) if len(t) else 0):
        s = np.einsum("ij,ij->i", x[rows], w[node]) - t[node]
        right = s > 0
        near = np.abs(s) < margin[rows]
        rows, node, pri = (
            np.concatenate([rows, rows[near]]),
            np.concatenate([2 * node + 1 + right, 2 * node[near] + 1 + ~right[near]]),
            np.concatenate([pri, np.maximum(pri[near], np.abs(s[near]))]),
        )
    order = np.lexsort((pri, rows))
    rows, node = rows[order], node[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < most
    return rows[keep], node[keep] - len(t)


def _leaves(x: np.ndarray, rng: np.random.Generator, leaf: int, aside: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One tree: (residents, visitors, their margins) of each leaf."""
    out, todo = [], [(np.arange(len(x)), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    while todo:
        own, vis, pri = todo.pop()
        if len(own) <= leaf:
            out.append((own, vis, pri))
            continue
        w, t = _plane(x[own[rng.integers(len(own), size=min(len(own), 256))]], rng, 3)
        s, v = x[own] @ w, x[vis] @ w
        t = float(np.median(s))
        ds, dv = np.abs(s - t), np.abs(v - t)
        right, vright = s > t, v > t
        if right.all() or not right.any():  # nothing tells these points apart
            right = np.arange(len(own)) % 2 == 1
        cut = float(np.quantile(ds, aside))
        for side in (False, True):
            cross, vcross = (right != side) & (ds <= cut), (vright != side) & (dv <= cut)
            same = vright == side
            todo.append((own[right == side], np.concatenate([vis[same], own[cross], vis[vcross]]), np.concatenate([pri[same], ds[cross], np.maximum(pri[vcross], dv[vcross])])))
    return out


def _pairs(x: np.ndarray, q: np.ndarray, r: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    s = x[q] @ x[r].T
    if floor > -1:
        i, j = np.nonzero(s >= floor)
    else:
        m = min(k + 1, len(r))
        j = np.argpartition(-s, m - 1, axis=1)[:, :m].ravel()
        i = np.repeat(np.arange(len(q)), m)
    return q[i], r[j]


def forest_neighbours(codes: np.ndarray, k: int, floor: float, trees: int = 5, leaf: int = 128, visits: int = 12, aside: float = 0.1, seed: int = 3, asks: np.ndarray | None = None):
    """(query, neighbour, similarity) of each query's k best among the candidates with similarity >= floor. Queries are all rows, or those marked in `asks`."""
    n = len(codes)
    asks = np.ones(n, bool) if asks is None else asks
    x = _unit(codes)
    loose = floor - 1e-4 if floor > -1 else floor
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rng = np.random.default_rng(seed)
    grown = [lv for _ in range(trees if n > leaf else 1) for lv in _leaves(x, rng, leaf, aside)]
    vis = np.concatenate([g[1] for g in grown])
    pri = np.concatenate([g[2] for g in grown])
    at = np.repeat(np.arange(len(grown)), [len(g[1]) for g in grown])
    vis, pri, at = vis[asks[vis]], pri[asks[vis]], at[asks[vis]]
    order = np.lexsort((pri, vis))  # the shared queue: each query's visits over all trees, nearest plane first
    vis, at = vis[order], at[order]
    keep = np.arange(len(vis)) - np.searchsorted(vis, vis) < visits
    vis, at = vis[keep], at[keep]
    order = np.argsort(at, kind="stable")
    vis, at = vis[order], at[order]
    edge = np.searchsorted(at, np.arange(len(grown) + 1))
    for i, (own, _, _) in enumerate(grown):
        q = np.concatenate([own[asks[own]], vis[edge[i] : edge[i + 1]]])
        for a in range(0, len(q), 4096):
            found.append(_pairs(x, q[a : a + 4096], own, k, loose))
    q, r = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    both = np.unique(np.concatenate([q * n + r, (r * n + q)[asks[r]]])) if n else np.zeros(0, np.int64)
    q, r = both // max(n, 1), both % max(n, 1)
    q, r = q[q != r], r[q != r]
    sim = np.empty(len(q))
    norm = np.sqrt((codes.astype(np.int64) ** 2).sum(axis=1).astype(np.float64))
    for a in range(0, len(q), 1 << 17):
        i, j = q[a : a + (1 << 17)], r[a : a + (1 << 17)]
        sim[a : a + (1 << 17)] = np.einsum("ij,ij->i", codes[i].astype(np.int64), codes[j].astype(np.int64)) / (norm[i] * norm[j])
    ok = sim >= floor
    q, r, sim = q[ok], r[ok], sim[ok]
    order = np.lexsort((r, -sim, q))
    q, r, sim = q[order], r[order], sim[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], sim[keep]


def neighbours(tables: dict[str, DataFrame], dim: int = 64, k: int = 5, min_similarity: float | None = None, asks=None, leaf_rows: int = 10_000, margin: float = 0.05, most_routes: int = 4, salts: int = 8, forest: dict | None = None, sample: int = SAMPLE) -> DataFrame:
    """{name: rows(id, embedding)} -> (tbl, id, neighbour, similarity): each usable vector's k most similar others.

    With min_similarity only neighbours at least that similar come out (and weaker candidates are dropped early). `asks` turns the id into
    whether it is a query. The defaults suit strong neighbours; weak ones, which lie anywhere, need THOROUGH: wider routes and more visits,
    for a set of queries rather than for all rows.
    """
    floor = -2.0 if min_similarity is None else float(min_similarity)
    ask = F.lit(True) if asks is None else F.coalesce(asks(F.col("id").cast("string")), F.lit(False))
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("tbl"), ask.alias("ask"), pack_id(F.col("id").cast("string")).alias("id"), "embedding") for n, d in tables.items()])
    rows = rows.where("id IS NOT NULL AND embedding IS NOT NULL")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast({n: _routes_of(d, n, dim, leaf_rows, sample) for n, d in tables.items()})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes of a task's rows without copies: each with its k + 1 smallest ids, and whether there are more."""
        held: dict[tuple[str, bytes], list] = {}
        for b in batches:
            ok, code = _usable_codes(b.column("embedding"), dim)
            b = b.filter(pa.array(ok))
            for t, i, m, c in zip(b.column("tbl").to_pylist(), b.column("id").to_pylist(), b.column("ask").to_pylist(), code):
                c = c.tobytes()
                got = held.setdefault((t, c), [[], False, False])
                got[2] |= m
                if i not in got[0]:
                    got[0].append(i)
                    if len(got[0]) > k + 1:
                        got[0].remove(max(got[0]))
                        got[1] = True
        for n in {t for t, _ in held}:
            mine = [(c, sorted(v[0]), v[1], v[2]) for (t, c), v in held.items() if t == n]
            for a in range(0, len(mine), 8192):
                part = mine[a : a + 8192]
                x = _unit(np.frombuffer(b"".join(m[0] for m in part), "<i2").reshape(-1, dim))
                wide = np.array([m[3] for m in part])
                row, leaf = routes(x, *shared.value[n], np.where(wide, margin, 0).astype(np.float32), most_routes) if shared.value[n] else (np.arange(len(x)), np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(row)), pa.array(leaf.astype(np.int32)), pa.array([part[i][1] for i in row], pa.list_(pa.binary())), pa.array([part[i][2] for i in row]), pa.array(wide[row]), pa.array([part[i][0] for i in row], pa.binary())],
                    ["tbl", "leaf", "ids", "more", "ask", "code"],
                )

    routed = rows.mapInArrow(route, "tbl string, leaf int, ids array<binary>, more boolean, ask boolean, code binary")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        classes: dict[bytes, list] = {}
        for c, i, m, a in zip(g["code"], g["ids"], g["more"], g["ask"]):
            got = classes.setdefault(c, [set(), False, False])
            got[0].update(i)
            got[1] |= bool(m)
            got[2] |= bool(a)
        held = sorted((sorted(v[0]), v[1], c, v[2]) for c, v in classes.items())
        codes = np.frombuffer(b"".join(h[2] for h in held), "<i2").reshape(-1, dim)
        q, r, sim = forest_neighbours(codes, k, floor, asks=np.array([h[3] for h in held]), **(forest or {}))
        mark = [h[0][0] + (b"\x01" if len(h[0]) > 1 else b"\x00") for h in held]
        rank = np.clip(np.rint((1 - sim) * 1e9), 0, 2**32 - 1).astype(">u4").tobytes()
        near: dict[int, list[bytes]] = {}
        for n, (a, z) in enumerate(zip(q.tolist(), r.tolist())):
            near.setdefault(a, []).append(rank[4 * n : 4 * n + 4] + mark[z])
        out = [(h[0][: k + 1], h[1] or len(h[0]) > k + 1, near.get(n, [])) for n, h in enumerate(held) if n in near or len(h[0]) > 1]
        return pd.DataFrame({"tbl": g["tbl"].iloc[0], "ids": [o[0] for o in out], "more": [o[1] for o in out], "near": [o[2] for o in out]})

    lists = routed.groupBy("tbl", "leaf").applyInPandas(search, "tbl string, ids array<binary>, more boolean, near array<binary>")
    # A neighbour is 4 bytes of distance, its id, a byte that tells whether it has copies: bytes sort as distances do. A class has
    # at most k of them from each of most_routes leaves.
    merged = lists.groupBy("tbl", F.element_at("ids", 1).alias("lo")).agg(F.first("ids").alias("ids"), F.max("more").alias("more"), F.collect_list("near").alias("near"))
    merged = materialise(merged.withColumn("near", F.slice(F.array_sort(F.array_distinct(F.flatten("near"))), 1, k)), "neighbours")
    plain = (F.size("ids") == 1) & ~F.exists("near", lambda x: F.endswith(x, F.unhex(F.lit("01"))))
    ident = lambda x: F.substring(x, 5, F.length(x) - 5)
    likeness = lambda x: F.lit(1.0) - F.conv(F.hex(F.substring(x, 1, 4)), 16, 10).cast("double") / 1e9
    single = merged.where(plain).select("tbl", F.col("lo").alias("id"), F.explode("near").alias("n")).select("tbl", "id", ident(F.col("n")).alias("neighbour"), likeness(F.col("n")).alias("similarity"))

    # Vectors that have copies, or neighbours with copies.
    copies = merged.where(F.size("ids") > 1).select("tbl", F.col("lo").alias("c"), F.col("ids").alias("copies"))
    knotty = merged.where(~plain).select("tbl", "lo", "ids", "more", F.posexplode_outer("near").alias("pos", "n"))
    spread = (
        knotty.withColumn("c", ident(F.col("n")))
        .join(copies, ["tbl", "c"], "left")
        .groupBy("tbl", "lo", "more")
        .agg(F.first("ids").alias("ids"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("pos", likeness(F.col("n")).alias("sim"), F.coalesce("copies", F.array("c")).alias("of"))))).alias("l"))
        .select("tbl", "lo", "more", "ids", F.flatten(F.transform("l", lambda x: F.transform(x["of"], lambda i: F.struct(x["sim"].alias("sim"), i.alias("id"))))).alias("others"))
    )
    members = spread.select("tbl", F.explode("ids").alias("id"), "ids", "others")
    big = spread.where("more")
    if not merged.where("more").isEmpty():  # ids beyond the k + 1 smallest of their class: a second look at all rows, salted
        mark = [F.xxhash64("code").alias("m1"), F.xxhash64(F.lit(1), "code").alias("m2")]
        coded = encode(rows, dim).select("tbl", "id", *mark)
        heads = coded.join(big.select("tbl", F.col("lo").alias("id"), "ids", "others"), ["tbl", "id"]).drop("id").dropDuplicates(["tbl", "m1", "m2"])
        heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rest = coded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(heads, ["tbl", "m1", "m2", "salt"])
        members = members.unionByName(rest.where(~F.array_contains("ids", F.col("id"))).select("tbl", "id", "ids", "others").dropDuplicates(["tbl", "id"]))
    own = F.transform(F.filter("ids", lambda c: c != F.col("id")), lambda c: F.struct(F.lit(1.0).alias("sim"), c.alias("id")))
    many = members.select("tbl", "id", F.explode(F.slice(F.concat(own, "others"), 1, k)).alias("n")).select("tbl", "id", F.col("n.id").alias("neighbour"), F.col("n.sim").alias("similarity"))
    every = single.unionByName(many)
    return every if asks is None else every.where(asks(unpack_id(F.col("id"))))


def _routes_of(d: DataFrame, name: str, dim: int, leaf_rows: int, sample: int = SAMPLE):
    """The planes that route a table's vectors, in the order of a full binary tree; None if one leaf holds all."""
    total = d.where("embedding IS NOT NULL").count()
    levels = max(0, math.ceil(math.log2(max(1, total) / leaf_rows)))
    if levels > MAX_LEVELS:
        raise ValueError(f"{total} vectors in leaves of {leaf_rows} need more than 2^{MAX_LEVELS} leaves: give larger leaf_rows")
    if not levels:
        return None
    some = d.select(F.lit(name).alias("tbl"), pack_id(F.col("id").cast("string")).alias("id"), "embedding").where("embedding IS NOT NULL")
    x = encode(some.orderBy(F.xxhash64("id")).limit(sample), dim).collect()
    if len(x) < 2 * PER_LEAF:
        return None
    x = np.unique(np.stack([np.frombuffer(bytes(r["code"]), "<i2") for r in x]), axis=0)
    upper = min(levels, int(math.log2(max(2, len(x) // 16))))
    w, t = fit_routes(_unit(x), upper)
    return (w, t) if upper == levels else _grow(some, w, t, upper, levels, dim, PER_LEAF * 2**levels / total)


def _grow(some: DataFrame, w: np.ndarray, t: np.ndarray, upper: int, levels: int, dim: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Further levels below each leaf of the upper ones, each subtree fitted in a task on the leaf's part of a second sample."""
    shared = some.sparkSession.sparkContext.broadcast((w, t))
    more = levels - upper

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(np.stack([np.frombuffer(c, "<i2") for c in b["code"]])) if len(b) else np.zeros((0, dim), np.float32)
            _, leaf = routes(x, *shared.value, np.zeros(len(x), np.float32), 1)
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "code": b["code"]})

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.unique(np.stack([np.frombuffer(c, "<i2") for c in g["code"]]), axis=0))
        sw, st = fit_routes(x, more, seed=int(g["leaf"].iloc[0]))
        return pd.DataFrame({"leaf": [g["leaf"].iloc[0]], "w": [sw.tobytes()], "t": [st.tobytes()]})

    picked = some.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    made = encode(picked, dim).select("code").mapInPandas(place, "leaf int, code binary").groupBy("leaf").applyInPandas(fit, "leaf int, w binary, t binary").collect()
    full_w, full_t = np.zeros((2**levels - 1, dim), np.float32), np.zeros(2**levels - 1, np.float32)
    full_w[: len(t)], full_t[: len(t)] = w, t
    for r in made:
        sw, st = np.frombuffer(bytes(r["w"]), np.float32).reshape(-1, dim), np.frombuffer(bytes(r["t"]), np.float32)
        for q in range(more):
            at = 2 ** (upper + q) - 1 + r["leaf"] * 2**q
            full_w[at : at + 2**q], full_t[at : at + 2**q] = sw[2**q - 1 : 2 ** (q + 1) - 1], st[2**q - 1 : 2 ** (q + 1) - 1]
    return full_w, full_t


def similar_pairs(tables: dict[str, DataFrame], min_similarity: float, **kw) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: pairs at least that similar, one of which is among the k nearest of the other."""
    n = neighbours(tables, min_similarity=min_similarity, **kw)
    return n.select("tbl", F.least("id", "neighbour").alias("x"), F.greatest("id", "neighbour").alias("y")).distinct().select("tbl", unpack_id(F.col("x")).alias("p"), unpack_id(F.col("y")).alias("q")).select("tbl", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
