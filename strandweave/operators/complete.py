"""Completions over a column of prompts: pluggable back-ends with retry and fallback, extraction with one repair, cited answers, judge scores."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.axes import AXES, NO_INFO
from strandweave.operators.ingest import payload_error, strip_fence

_BACKENDS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def register_backend(name: str, make: Callable[[], Callable[[list[str]], list[str]]]) -> None:
    """make() is called once per task and returns prompts -> completions, in order; a model behind a network or in the process fits in here."""
    _BACKENDS[name] = make


def complete(df: DataFrame, prompt: str, out: str, provider: str = "rules", fallback: str | None = None, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Adds `out` and `out`_error. A batch of prompts that fails is tried again up to `tries` times, after `wait` seconds and then twice as long each time, and
    then with the fallback; if that fails too, its rows have no completion and the last error. A null prompt has neither."""
    makers = []
    for name in [provider] + ([fallback] if fallback else []):
        if name not in _BACKENDS:
            raise ValueError(f"no such completion provider: {name}")
        makers.append(_BACKENDS[name])

    @F.pandas_udf("struct<text:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made: dict[int, Callable] = {}
        for s in batches:
            ask = s[s.notna()].tolist()
            got, error = [None] * len(ask), None
            for n, again in [(i, j) for i in range(len(makers)) for j in range(tries)] if ask else []:
                if again:
                    time.sleep(wait * 2 ** (again - 1))
                try:
                    made.setdefault(n, makers[n]())
                    got, error = list(made[n](ask)), None
                    if len(got) != len(ask):
                        raise ValueError(f"{len(got)} completions of {len(ask)} prompts")
                    break
                except Exception as e:  # noqa: BLE001  whatever a back-end raises counts as a failed try
                    got, error = [None] * len(ask), f"{type(e).__name__}: {e}"
            answers = iter(got)
            yield pd.DataFrame([(None, None) if p is None else (next(answers), error) for p in s.where(s.notna(), None)], columns=["text", "error"])

    return df.withColumn("__c", run(F.col(prompt))).withColumns({out: F.col("__c.text"), f"{out}_error": F.col("__c.error")}).drop("__c")


EXTRACT = f"""Task: extract
Read the passage below and list what it states. Reply with JSON alone: an object whose key "propositions" holds a list; each entry has "text", one
self-contained sentence, and "triples", a list of objects with "subject", "predicate", "object", "ontology_axis" (one of {", ".join(AXES)}) and
"confidence", a number from 0 to 1. Leave out what the passage does not say.
Passage:
"""
REPAIR = "\nYour reply to this was refused: "
JUDGE = """Task: judge
Give the answer a whole number from 0 (wrong or missing) to 4 (says all that the reference says) and nothing else.
"""


def extract(buffers: DataFrame, provider: str = "rules", fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """buffers(..., text) -> (buffers with a valid `payload`, refused ones with error_type and error_message). A reply that is refused is asked for once more,
    with the reason; what fails again is refused for good."""
    cols = buffers.columns
    first = complete(buffers.withColumn("__p", F.concat(F.lit(EXTRACT), F.col("text"))), "__p", "payload", provider, fallback)
    why = F.coalesce(F.col("payload_error"), payload_error(F.col("payload")), F.when(F.col("payload").isNull(), F.lit("no reply")))
    first = first.withColumn("__why", why).drop("payload_error")
    again = first.withColumn("__p", F.when(F.col("__why").isNotNull(), F.concat("__p", F.lit(REPAIR), "__why")))
    again = complete(again, "__p", "__second", provider, fallback)
    told = F.coalesce(F.col("__second_error"), payload_error(F.col("__second")), F.when(F.col("__second").isNull(), F.lit("no reply")))
    both = again.withColumns({"__why2": F.when(F.col("__why").isNotNull(), told), "payload": F.when(F.col("__why").isNull(), F.col("payload")).otherwise(F.col("__second"))})
    good = both.where("__why2 IS NULL").select(*cols, strip_fence(F.col("payload")).alias("payload"))
    bad = both.where("__why2 IS NOT NULL").select(*cols, F.when(F.col("__second_error").isNotNull(), "completion").otherwise("validation").alias("error_type"), F.col("__why2").alias("error_message"))
    return good, bad


def answers(prompts: DataFrame, provider: str = "rules", fallback: str | None = None) -> DataFrame:
    """prompts(qid, n_propositions, prompt) -> qid, n_propositions, answer; without propositions the fixed sentence, and no completion is asked for."""
    asked = complete(prompts.withColumn("__p", F.when(F.col("n_propositions") > 0, F.col("prompt"))), "__p", "__a", provider, fallback)
    return asked.select("qid", "n_propositions", F.coalesce("__a", F.lit(NO_INFO)).alias("answer"))


def judge_prompts(rows: DataFrame) -> DataFrame:
    """rows(qid, question, gold_answer, answer) with the prompt that asks for a score."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit("\n"))
    return rows.withColumn("prompt", F.concat(F.lit(JUDGE), part("Question", F.col("question")), part("Reference", F.col("gold_answer")), part("Answer", F.col("answer"))))


# ---------------------------------------------------------------- the offline back-end


_CUES = (("causal", ("because", "causes", "when", "if")), ("temporal", ("before", "after", "until", "since")), ("taxonomic", ("kind", "type", "each", "every")), ("exemplification", ("example", "instance", "such")))


def _propositions(passage: str) -> dict:
    out = []
    for s in re.split(r"(?<=[.?!])\s+", passage.strip()):
        w = re.findall(r"\w+", s)
        if len(w) >= 3:
            low = [x.lower() for x in w]
            axis = next((a for a, cues in _CUES if any(c in low for c in cues)), "definitional")
            out.append({"text": s, "triples": [{"subject": w[0], "predicate": low[1], "object": w[-1], "ontology_axis": axis, "confidence": 0.5}]})
    return {"propositions": out}


def _rules() -> Callable[[list[str]], list[str]]:
    """Works by rule, so that every stage runs without a model: a triple for each sentence, an answer that cites all its evidence, a score by shared words."""
    import json

    def one(p: str) -> str:
        if p.startswith("Task: extract"):
            return json.dumps(_propositions(p[len(EXTRACT) :].split(REPAIR)[0]))
        if p.startswith("Task: judge"):
            said = {k: set(re.findall("[a-z0-9]+", v.lower())) for k, v in re.findall(r"^(Reference|Answer): (.*)$", p, re.M)}
            gold = said.get("Reference", set())
            return str(min(4, 5 * len(gold & said.get("Answer", set())) // max(1, len(gold))))
        marks = [m for m in re.findall(r"^\[(P\d+)\] ", p, re.M)]
        return f"It is stated in {', '.join(f'[{m}]' for m in marks)}." if marks else NO_INFO

    return lambda prompts: [one(p) for p in prompts]


register_backend("rules", _rules)
