"""Settings: defaults, then a YAML file, then STRANDWEAVE__SECTION__KEY variables (case does not matter)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Retrieve:
    seed_k_entities: int = 8
    seed_k_propositions: int = 16
    max_subgraph_edges: int = 2048
    hops: int = 1


@dataclass(frozen=True)
class Reweight:
    alpha: float = 8.0
    beta: float = 0.0


@dataclass(frozen=True)
class Rank:
    damping: float = 0.85
    top_m: int = 20
    iterations: int = 20


@dataclass(frozen=True)
class Answer:
    budget_tokens: int = 4000


@dataclass(frozen=True)
class Ingest:
    span_max_tokens: int = 1200
    overlap_tokens: int = 100


@dataclass(frozen=True)
class Embedding:
    dim: int = 64
    provider: str = "hash"


@dataclass(frozen=True)
class Config:
    retrieve: Retrieve = field(default_factory=Retrieve)
    reweight: Reweight = field(default_factory=Reweight)
    rank: Rank = field(default_factory=Rank)
    answer: Answer = field(default_factory=Answer)
    ingest: Ingest = field(default_factory=Ingest)
    embedding: Embedding = field(default_factory=Embedding)


def load(path: str | None = None, env: dict | None = None) -> Config:
    """A missing explicit file is an error; without a path ./config.yaml is taken if it is there."""
    given: dict = {}
    if path is not None and not os.path.exists(path):
        raise FileNotFoundError(path)
    path = path or ("config.yaml" if os.path.exists("config.yaml") else None)
    if path:
        import yaml

        with open(path) as f:
            given = {k: dict(v or {}) for k, v in (yaml.safe_load(f) or {}).items()}
    for k, v in (os.environ if env is None else env).items():
        p = k.lower().split("__")
        if len(p) == 3 and p[0] == "strandweave":
            given.setdefault(p[1], {})[p[2]] = v
    c = Config()
    for f in fields(Config):
        part = getattr(c, f.name)
        own = {x.name: type(getattr(part, x.name)) for x in fields(part)}
        c = replace(c, **{f.name: replace(part, **{k: own[k](v) for k, v in given.get(f.name, {}).items() if k in own})})
    return c
