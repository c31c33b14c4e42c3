"""Documents to spans: markdown sections, plain text, pages of PDF; from a table of texts or a folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.ingest import span_hash

SUFFIXES = (".md", ".markdown", ".txt", ".pdf")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")
SPANS = "doc_id string, section_path string, span_no int, text string"


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(section path, body). Headings (# or underlined) open sections; a heading of level n replaces the path from its n-th part on,
    and skipped levels do not pad it. Prose and code are kept, raw HTML blocks are dropped."""
    path: list[str] = []
    blocks: list[str] = []
    para: list[str] = []

    def close() -> None:
        if para:
            blocks.append("\n".join(x.strip() for x in para))
            para.clear()

    def body() -> str:
        close()
        out = "\n\n".join(blocks).strip()
        blocks.clear()
        return out

    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        fence, atx = _FENCE.match(line), _ATX.match(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            close()
            end = re.compile(r" {0,3}" + re.escape(fence[1][0]) + "{%d,}[ \t]*$" % len(fence[1]))
            code = []
            i += 1
            while i < len(lines) and not end.match(lines[i]):
                code.append(lines[i])
                i += 1
            blocks.append("\n".join(code) + "\n")
        elif atx or (para and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line)):
            title = (atx[2] or "").strip() if atx else " ".join(x.strip() for x in para)
            level = len(atx[1]) if atx else 1 if "=" in line else 2
            if not atx:
                para.clear()
            text_ = body()
            if text_:
                yield " / ".join(path), text_
            path[level - 1 :] = [title]
        elif not line.strip():
            close()
        elif not para and line.startswith(("    ", "\t")):
            code = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                code.append(lines[i][4:] if lines[i].startswith("    ") else lines[i][1:])
                i += 1
            blocks.append("\n".join(code).rstrip("\n") + "\n")
            continue
        elif not para and _HTML.match(line):
            while i < len(lines) and lines[i].strip():
                i += 1
            continue
        else:
            item = re.match(r"\s*(?:[-*+]|\d{1,9}[.)])\s+", line)
            if item:
                close()
            para.append(line[item.end() :] if item else line.lstrip("> ") if line.startswith(">") else line)
        i += 1
    text_ = body()
    if text_:
        yield " / ".join(path), text_


def markdown_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([(d, p, n, b) for d, t in zip(x["d"], x["t"]) for n, (p, b) in enumerate(sections(t), 1)], columns=["doc_id", "section_path", "span_no", "text"])

    out = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).where("t IS NOT NULL").mapInPandas(run, SPANS)
    return with_hash(out)


def text_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A whole text is one span of section ''."""
    t = F.trim(F.col(text), F.lit(" \t\r\n\x0b\x0c"))
    return with_hash(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.lit("").alias("section_path"), F.lit(1).alias("span_no"), t.alias("text")).where("text <> ''"))


def with_hash(spans: DataFrame) -> DataFrame:
    return spans.withColumn("hash", span_hash(F.col("doc_id"), F.col("section_path"), F.col("text")))


def walk(spark: SparkSession, folder: str, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Spans of all files below a folder with a known suffix; doc_id is the path relative to it. PDF needs a page extractor."""
    root = folder.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root) + "/", "")
    f = f.select(rel.alias("doc_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content").where(F.col("suffix").isin(*SUFFIXES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for d, s, c in zip(x["doc_id"], x["suffix"], x["content"]):
                if s == ".pdf":
                    if pdf_pages is None:
                        raise ValueError("PDF files need a page extractor: walk(..., pdf_pages=f)")
                    out += [(d, f"page-{n}", n, t.strip()) for n, t in enumerate(pdf_pages(c), 1) if t.strip()]
                elif s == ".txt":
                    t = c.decode("utf-8", "replace").strip()
                    out += [(d, "", 1, t)] if t else []
                else:
                    out += [(d, p, n, b) for n, (p, b) in enumerate(sections(c.decode("utf-8", "replace")), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "section_path", "span_no", "text"])

    return with_hash(f.mapInPandas(run, SPANS))
