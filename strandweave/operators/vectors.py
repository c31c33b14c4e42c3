"""Vectors as array<float> columns: embedding back-ends, cosine, norms and batched top-k."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.axes import AXES, AXIS_TEXTS

MAX_QUESTIONS = 10_000
CELLS = 4_000_000  # distances that a task holds at once
_TOKEN = re.compile("[a-z0-9]+")
_BACKENDS: dict[str, Callable[[int], Callable[[list[str]], np.ndarray]]] = {}


def register_backend(name: str, make: Callable[[int], Callable[[list[str]], np.ndarray]]) -> None:
    """make(dim) is called once per task and returns texts -> matrix; a network or local model fits in here."""
    _BACKENDS[name] = make


def _hash_backend(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Feature hashing of words by MD5: deterministic, and expressible in SQL."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in _TOKEN.findall((t or "").lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                out[i, int(h[:4], 16) % dim] += 1.0 if int(h[4], 16) < 8 else -1.0
        return out

    return embed


register_backend("hash", _hash_backend)


def local_model(name: str, load: Callable | None = None) -> Callable[[int], Callable[[list[str]], np.ndarray]]:
    """For `register_backend`: a model in the task's process, loaded once a task, that encodes a batch at a time. load(name) gives an object with encode(texts);
    without it, sentence_transformers must be installed on the workers."""

    def make(dim: int) -> Callable[[list[str]], np.ndarray]:
        loader = load
        if loader is None:
            from sentence_transformers import SentenceTransformer as loader
        model = loader(name)
        return lambda texts: np.asarray(model.encode(texts), np.float32)

    return make


def embed(df: DataFrame, text: str, out: str, dim: int = 64, provider: str = "hash") -> DataFrame:
    """Adds `out`, array<float>, from the back-end named; a back-end that yields another size is an error."""
    if provider not in _BACKENDS:
        raise ValueError(f"no such embedding provider: {provider}")
    make = _BACKENDS[provider]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make(dim)
        for s in batches:
            m = np.asarray(f(s.fillna("").tolist()), np.float32).reshape(len(s), -1)
            if len(s) and m.shape[1] != dim:
                raise ValueError(f"the back-end gives {m.shape[1]} numbers, not {dim}")
            yield pd.Series(list(m))

    return df.withColumn(out, run(F.col(text)))


def axis_vectors(spark, dim: int = 64, provider: str = "hash") -> DataFrame:
    """axis, vec: five rows in the fixed order."""
    d = spark.createDataFrame([(i, a, AXIS_TEXTS[a]) for i, a in enumerate(AXES)], "axis_no int, axis string, text string")
    return embed(d, "text", "vec", dim, provider).select("axis_no", "axis", "vec")


def usable(v: Column | str, dim: int = 64) -> Column:
    """dim numbers, none null or NaN, not all zero."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    mul = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(mul, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 0.0) -> Column:
    """floor > 0 bounds each norm from below, so a zero vector has cosine 0 instead of null."""
    den = F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)) if floor else norm(a) * norm(b)
    return dot(a, b) / F.when(den != 0, den)


def normalised(v: Column) -> Column:
    """v at length one; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def top_k(questions: DataFrame, vectors: DataFrame, k: int, dim: int = 64, scope: str | None = None, block: int = MAX_QUESTIONS, meet: Callable | None = None) -> DataFrame:
    """questions(qid, qvec), vectors(id, embedding) -> qid, id, distance, rank: each question's k nearest by cosine distance,
    equal distances (to 9 digits) by id. Each task keeps k candidates per question; one window merges them. Rows that repeat an id count once. The
    questions go to the tasks in blocks of about `block`, each of which reads the vectors once.

    With scope, a text column of vectors, each question asks each value of it alone: k rows per (qid, value), the column in the
    result; vectors without a value belong to no scope. With `meet` (see _nearest), a question is compared with some vectors only."""
    q = questions.select("qid", "qvec")
    rows = q.limit(block + 1).collect()
    if len(rows) <= block:
        parts = [_nearest(q, rows, vectors, k, dim, scope, meet)]
    else:
        n = -(-2 * q.count() // block)
        at = F.pmod(F.xxhash64("qid"), F.lit(n))
        parts = [_nearest(q, q.where(at == i).collect(), vectors, k, dim, scope, meet) for i in range(n)]
    by = [scope] if scope else []
    w = W.partitionBy("qid", *by).orderBy("distance", "id")
    part = reduce(DataFrame.unionByName, parts).dropDuplicates(["qid", *by, "id"])
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(questions: DataFrame, rows: list, vectors: DataFrame, k: int, dim: int, scope: str | None, meet: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """Each task's k nearest to each of the questions in rows. meet(question vectors) gives a function of vectors that tells which of them each question is
    compared with (a row a question); without it, all."""
    qids = [r["qid"] for r in rows]
    q = np.array([r["qvec"] for r in rows], np.float64).reshape(-1, dim)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, n, out=np.zeros_like(q), where=n > 0)
    shared = questions.sparkSession.sparkContext.broadcast((qids, q))
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        best = {}
        met = meet(m) if meet else None
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), dim), False))
            if not b.num_rows or not ids:
                continue
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, own = x[ok], np.array(b.column("id").to_pylist(), object)[ok]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            of = np.array(b.column(scope).to_pylist(), object)[ok] if scope else None
            step = max(64, CELLS // len(ids))  # what is held at once doesn't grow with questions times rows
            for lo in range(0, len(x), step):
                names = own[lo : lo + step]
                every = np.round(1 - m @ x[lo : lo + step].T, 9)
                if met:
                    every[~met(x[lo : lo + step])] = np.inf
                parts: dict = {None: np.arange(len(names))} if scope is None else {}
                for n, v in enumerate(of[lo : lo + step] if scope else ()):
                    parts.setdefault(v, []).append(n)
                for v, at in parts.items():
                    got = best.setdefault(v, [[] for _ in ids])
                    d, called = every[:, at], names[at]
                    wide = d.shape[1] > 4 * k
                    low = np.argpartition(d, 4 * k, axis=1)[:, : 4 * k] if wide else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                    for r in range(len(ids)):
                        c = low[r]
                        if len(got[r]) == k and d[r, c].min() > got[r][-1][0]:  # nothing nearer
                            continue
                        new = _first(got[r] + list(zip(d[r, c].tolist(), called[c].tolist())), k)
                        if wide and (len(new) < k or d[r, c].max() <= new[-1][0]):  # repeats or ties beyond what was looked at
                            new = _first(got[r] + list(zip(d[r].tolist(), called.tolist())), k)
                        got[r] = new
        for v, got in best.items():
            flat = [(q, i, d) for q, g in zip(ids, got) for d, i in g if d < np.inf]
            if flat:
                cols = [pa.array([f[n] for f in flat]) for n in range(3)] + ([pa.array([v] * len(flat), pa.string())] if scope else [])
                yield pa.RecordBatch.from_arrays(cols, ["qid", "id", "distance"] + ([scope] if scope else []))

    qkind = questions.schema["qid"].dataType.simpleString()
    by = [scope] if scope else []
    rows = vectors.select("id", "embedding", *by).where("id IS NOT NULL AND embedding IS NOT NULL")
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    return rows.mapInArrow(run, f"qid {qkind}, id {kind}, distance double" + "".join(f", {c} string" for c in by))


def _first(pairs: list[tuple], k: int) -> list[tuple]:
    """The k smallest (distance, id), each id once."""
    out, seen = [], set()
    for d, i in sorted(pairs):
        if i not in seen:
            seen.add(i)
            out.append((d, i))
            if len(out) == k:
                break
    return out
