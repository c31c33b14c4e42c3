"""From a folder to the graph, and from a question to a cited answer."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.config import Config
from strandweave.operators import answer, complete, evaluate, ingest
from strandweave.operators.units import units_from_payloads
from strandweave.plans.retrieval import Retrieval, prompts
from strandweave.session import materialise
from strandweave.sources import markdown, sinks
from strandweave.store import Store


def ingest_folder(store: Store, folder: str, source: str, cfg: Config, provider: str = "rules", fallback: str | None = None, failures: str | None = None, pdf_pages=None) -> dict:
    """Spans -> buffers -> those the ledger does not have -> extraction, with one repair -> entities, propositions, edges. Refused replies go to the quarantine
    table and, where given, the failure log; their spans stay out of the ledger and are tried again next time."""
    spark = store.spark
    spans = materialise(markdown.walk(spark, folder, pdf_pages), "spans")
    b = ingest.pack(spans, cfg.ingest.span_max_tokens, cfg.ingest.overlap_tokens)
    b = b.withColumn("unit_id", F.md5(F.concat_ws("\x1f", F.lit(source), "doc_id", "section_path", F.col("buffer_no").cast("string"), F.array_join("span_hashes", ","))))
    todo = materialise(ingest.not_in_ledger(b, store.read("ledger"), "unit_id"), "todo")
    good, bad = complete.extract(todo, provider, fallback)
    good, bad = materialise(good, "extracted"), materialise(bad, "refused")
    raw = good.select("unit_id", F.lit(source).alias("source_id"), "payload", F.current_timestamp().alias("received_at"))
    units = units_from_payloads(raw).select("unit_id", "source_id", "propositions", "received_at").join(good.select("unit_id", "doc_id", "section_path", "span_hashes"), "unit_id")
    done = good.select(F.explode("span_hashes").alias("hash")).distinct().join(bad.select(F.explode("span_hashes").alias("hash")).distinct(), "hash", "left_anti")
    store.ingest(units, spans.join(done, "hash", "left_semi"), bad)
    if failures:
        sinks.append_failures(bad, failures)
    return {"spans": spans.count(), "buffers": b.count(), "skipped": b.count() - todo.count(), "extracted": good.count(), "refused": bad.count()}


def ask(store: Store, questions: DataFrame, source_id: str | None = None, provider: str = "rules", fallback: str | None = None) -> DataFrame:
    """questions(qid, question) -> qid, question, answer, cited (numbers), evidence (their propositions, in order of rank)."""
    r = Retrieval(store.spark, store, questions, source_id)
    a = complete.answers(prompts(r), provider, fallback)
    cited = answer.citations(a).groupBy("qid").agg(F.array_sort(F.collect_set("cited")).alias("cited"))
    kept = answer.within_budget(r.fetched, r.questions).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "text", "source_doc", "source_span"))).alias("evidence"))
    return questions.join(a, "qid").join(cited, "qid", "left").join(kept, "qid", "left").select("qid", "question", "answer", F.coalesce("cited", F.array().cast("array<bigint>")).alias("cited"), "evidence")


SYSTEMS = ("graph", "nearest")


def systems(named: str) -> list[str]:
    """A comma-separated list of systems; blanks around names and empty ones are dropped, each is run once, an unknown one is an error."""
    found = list(dict.fromkeys(s.strip() for s in named.split(",") if s.strip()))
    unknown = [s for s in found if s not in SYSTEMS]
    if unknown or not found:
        raise ValueError(f"systems are {', '.join(SYSTEMS)}, not {', '.join(unknown) or 'none'}")
    return found


def bench(store: Store, suite: DataFrame, systems: list[str]) -> DataFrame:
    """Medians by system over a suite, all stages by the offline back-end: correctness as its judge scores it, and the seconds a question took in the batch."""
    spark, out = store.spark, []
    q = suite.select(F.col("id").alias("qid"), "question")
    for system in systems:
        start = time.time()
        r = Retrieval(spark, store, q)
        found = r.fetched if system == "graph" else materialise(r.nearest(10), "nearest")
        p = answer.answer_prompts(answer.within_budget(found, r.questions), r.questions)
        a = materialise(complete.answers(p), "answers")
        took = (time.time() - start) / max(1, q.count())
        ref = F.concat(F.coalesce("source_doc", F.lit("")), F.lit("#"), F.coalesce("source_span", F.lit("")))
        e = found.groupBy("qid").agg(F.array_sort(F.collect_set(ref)).alias("pred"), F.sum(answer.word_count(F.col("text"))).alias("tokens"), F.sum(F.length("text")).cast("double").alias("chars_read"))
        rows = suite.withColumnRenamed("id", "qid").join(a, "qid").join(e, "qid", "left")
        rows = complete.complete(complete.judge_prompts(rows), "prompt", "reply")
        pr, rc = evaluate.citation_scores(F.col("gold_doc_ids"), F.col("pred"))
        out.append(rows.select(F.lit(system).alias("system"), evaluate.judge_score(F.col("reply")).alias("correctness"), "chars_read", "tokens", pr.alias("citation_precision"), rc.alias("citation_recall"), F.lit(took).alias("seconds")))
    every = materialise(reduce(DataFrame.unionByName, out), "bench")
    return evaluate.medians(every, ["system"]).join(every.groupBy("system").agg(F.max("seconds").alias("seconds_a_question")), "system")
