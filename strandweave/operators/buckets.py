"""Approximate top-k by hyperplane buckets: a question is compared with the vectors of the buckets near its own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from strandweave.operators.vectors import top_k, usable


def sharing(tables: int, bits: int, near: int, dim: int, seed: int = 5) -> Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """For `top_k`: questions -> vectors -> whether they share a bucket in some table; a question falls into those beyond its `near` closest planes as well."""

    def meet(questions: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
        power = 1 << np.arange(bits)

        def sides(x: np.ndarray) -> np.ndarray:
            return (x @ planes.T).reshape(len(x), tables, bits)

        m = sides(questions)
        own = (m > 0) @ power
        probed = np.zeros((tables, 1 << bits, len(questions)), bool)
        for t in range(tables):
            probed[t, own[:, t], np.arange(len(questions))] = True
            for j in np.argsort(np.abs(m[:, t]), axis=1)[:, :near].T:
                probed[t, own[:, t] ^ power[j], np.arange(len(questions))] = True

        def met(vectors: np.ndarray) -> np.ndarray:
            at = (sides(vectors) > 0) @ power
            out = np.zeros((len(vectors), len(questions)), bool)
            for t in range(tables):
                out |= probed[t, at[:, t]]
            return out.T

        return met

    return meet


def bucket_top_k(questions: DataFrame, vectors: DataFrame, k: int, tables: int = 20, bits: int = 6, near: int = 5, dim: int = 64) -> DataFrame:
    """questions(qid, qvec), vectors(id, embedding) -> qid, id, distance, rank among the rows that share a bucket. Without a
    bucket in common nothing is found, so fewer than k rows may come out; `top_k` is the exact way.

    Buckets are told and compared where the vectors lie; only each task's k candidates of a question are moved."""
    return top_k(questions.where(usable("qvec", dim)), vectors, k, dim, meet=sharing(tables, bits, near, dim))
