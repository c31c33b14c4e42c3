"""Back-ends for models behind HTTP: each task sends one JSON request a text. What a task sends with can be replaced, as tests do."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import numpy as np

Send = Callable[[str, dict, float], dict]


def post(url: str, body: dict, timeout: float) -> dict:
    """The reply to one JSON request; whatever goes wrong is raised, so that the caller's retries see it."""
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(ask, timeout=timeout) as r:
        return json.loads(r.read())


def pick(reply: dict, path: str):
    """The value at a dotted path; numbers are positions in lists."""
    for p in path.split("."):
        reply = reply[int(p)] if isinstance(reply, list) else reply[p]
    return reply


def embeddings(url: str, model: str, field: str = "prompt", path: str = "embedding", timeout: float = 60, send: Send = post) -> Callable[[int], Callable[[list[str]], np.ndarray]]:
    """For `vectors.register_backend`: the numbers at `path` of the reply to {model, field: text}."""

    def make(dim: int) -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.array([pick(send(url, {"model": model, field: t}, timeout), path) for t in texts], np.float32).reshape(len(texts), -1)

    return make


def completions(
    url: str, model: str, system: str | None = None, temperature: float = 0.0, path: str = "message.content", timeout: float = 120, extra: dict | None = None, send: Send = post
) -> Callable[[], Callable[[list[str]], list[str]]]:
    """For `complete.register_backend`: the text at `path` of the reply to a list of messages; `extra` is added to each request."""

    def one(prompt: str) -> str:
        said = [{"role": "system", "content": system}] if system else []
        body = {"model": model, "messages": [*said, {"role": "user", "content": prompt}], "stream": False, "temperature": temperature}
        return str(pick(send(url, body | (extra or {}), timeout), path))

    return lambda: lambda prompts: [one(p) for p in prompts]
