"""Command line: init, ingest a folder, query, sources, export, bench."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from strandweave import config, pipeline
from strandweave.operators import answer, ingest
from strandweave.session import local_session
from strandweave.sources import sinks
from strandweave.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandweave")
    p.add_argument("--config")
    p.add_argument("--store", default="store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="create the tables")
    c.add_argument("--rebuild", action="store_true")
    c = sub.add_parser("ingest", help="a folder into the graph: spans, buffers, extraction, upserts")
    c.add_argument("folder")
    c.add_argument("--source", help="a source id, or what to make it from (default: the folder's real path)")
    c.add_argument("--provider", default="rules")
    c.add_argument("--fallback")
    c.add_argument("--failures", help="folder for a log of refused replies")
    c.add_argument("--reextract", action="store_true")
    c = sub.add_parser("sources", help="sources that the graph holds")
    c = sub.add_parser("export", help="finetuning examples")
    c.add_argument("--out", required=True)
    c.add_argument("--format", default="finetune")
    c.add_argument("--source")
    c = sub.add_parser("bench", help="answers an evaluation suite over the store; medians by system, and seconds a question")
    c.add_argument("suite", help="JSON lines")
    c.add_argument("--systems", default="graph,nearest")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("query", help="a cited answer to a question")
    c.add_argument("question")
    c.add_argument("--source")
    c.add_argument("--provider", default="rules")
    c.add_argument("--fallback")
    c.add_argument("--dry-run", action="store_true")
    return p


def _source(spark, arg: str) -> str:
    return spark.range(1).select(ingest.source_id(F.lit(arg))).first()[0]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        cfg = config.load(a.config)
    except FileNotFoundError as e:
        print(f"no such config: {e}", file=sys.stderr)
        return 1
    if a.command == "export" and a.format != "finetune":
        print("only finetune is supported", file=sys.stderr)
        return 2
    if a.command == "query" and a.dry_run:
        print(json.dumps({"question": a.question, "source": a.source, "top_m": cfg.rank.top_m}))
        return 0
    spark = local_session()
    store = Store(spark, a.store)
    if a.command == "init":
        store.init(a.rebuild)
        print(" ".join(store.tables()))
    elif a.command == "ingest":
        if a.reextract:
            store.clear_ledger()
        sid = _source(spark, a.source or os.path.realpath(a.folder))
        store.register_source(sid, a.folder)
        print(json.dumps({"source_id": sid} | pipeline.ingest_folder(store, a.folder, sid, cfg, a.provider, a.fallback, a.failures)))
    elif a.command == "sources":
        rows = [r[0] for r in store.sources().collect()]
        print("\n".join(rows) if rows else "(no sources)")
    elif a.command == "export":
        p = store.read("proposition")
        if a.source:
            p = p.where(F.col("source_id") == _source(spark, a.source))
        e = store.read("rel").select(F.md5(F.concat_ws("|", "src", "dst", "predicate")).alias("id"), "src", "dst", "predicate", "axis", "support")
        print(sinks.write_jsonl(answer.training_examples(answer.supporting_edges(p, e)), a.out))
    elif a.command == "query":
        q = spark.createDataFrame([("q", a.question)], "qid string, question string")
        r = pipeline.ask(store, q, _source(spark, a.source) if a.source else None, a.provider, a.fallback).first()
        print(r["answer"])
        for n, e in enumerate(r["evidence"] or [], 1):
            print(f"[P{n}]{'*' if n in r['cited'] else ' '} ({e['source_doc'] or ''}#{e['source_span'] or ''}) {e['text']}")
    else:
        pipeline.bench(store, sinks.read_suite(spark, a.suite, a.limit), pipeline.systems(a.systems)).show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
