"""Problem 7: sources mixed to target weights.

A time-varying curriculum. Each source has a schedule of weights over training time 0..1, linear between knots. Its integral times the
mixture's size is the source's cumulative demand for tokens; a document whose tokens lie at some point of its source's cumulative
supply gets the time at which the demand reaches that point (the inverse of a piecewise quadratic). The mixture is
the documents range-sorted by that position.

Cumulative supply is a prefix sum in two levels: documents fall by hash into as many buckets as their source has `bucket_rows` records, bucket totals are
summed up (a window of one row a bucket), and a window sums within (source, bucket), so no source is ever in one task. A source is
repeated in whole passes, at most max_repeats times.

The size is stated: a number of tokens, or a function of plan()'s result. At a stated size a source that runs out falls short, and the report
says by how much. `largest_exact` is the size up to which every source that has tokens keeps its share; `all_tokens` is what the listed sources
hold. Shares of listed sources without tokens cannot be met and are spread over the others in proportion.

Cases: null and empty texts have no tokens and are not used; null or unlisted sources are not used; a target that is null or not
positive is no target; a null max_repeats is 1; equal doc_ids are separate records; a repeated source in the targets
counts once, with its largest share; empty tables give no row; only doc_id, source and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.session import materialise

MAX_SOURCES = 100_000
_ENCODERS: dict = {}


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens of the whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path or tokenizer_file())  # found where the task runs
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "tokens": [len(enc.encode_ordinary(t)) for t in x["text"]]})

    return docs.select("doc_id", "source", "text").where("text IS NOT NULL AND source IS NOT NULL").mapInPandas(run, f"doc_id {kind}, source string, tokens long")


def tilted_schedule(shares: dict[str, float], repeats: dict[str, int], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """Knots (time, weight) per source: sources that may be repeated more come later. Weights add up to 1 at any time, and each
    source's integral is its share."""
    mean = sum(s * repeats[k] for k, s in shares.items())
    far = max([abs(repeats[k] - mean) for k in shares] or [0]) or 1.0
    lean = {k: tilt * (repeats[k] - mean) / far for k in shares}
    return {k: [(0.0, s * (1 - lean[k])), (1.0, s * (1 + lean[k]))] for k, s in shares.items()}


def _segments(schedule: dict[str, list[tuple[float, float]]], total: float) -> list[tuple]:
    """(source, t0, t1, w0, w1, y0, y1) in tokens: the demand from y0 to y1 falls between t0 and t1."""
    out = []
    for s, knots in schedule.items():
        y = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            z = y + total * (t1 - t0) * (w0 + w1) / 2
            out.append((s, t0, t1, w0 * total, w1 * total, y, z))
            y = z
    return out


def _time_at(y: Column) -> Column:
    """Within a segment: the time at which its demand reaches y."""
    rise, need, span = F.col("w1") - F.col("w0"), y - F.col("y0"), F.col("t1") - F.col("t0")
    curved = (F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * rise * need / span)) - F.col("w0")) / F.when(rise != 0, rise)
    flat = need / F.when(F.col("w0") > 0, F.col("w0") * span)
    return F.col("t0") + span * F.coalesce(F.when(F.abs(rise) > 1e-9 * (F.col("w0") + F.col("w1")), curved), flat, F.lit(0.0))


@dataclass(frozen=True)
class Plan:
    """What the targets and the supply say: shares that add up to 1, repeats, tokens and records of each source that has tokens."""

    shares: dict[str, float]
    repeats: dict[str, int]
    tokens: dict[str, int]
    records: dict[str, int]


def largest_exact(p: Plan) -> float:
    """The most tokens for which no source runs out."""
    return min([p.tokens[s] * p.repeats[s] / p.shares[s] for s in p.shares] or [0.0])


def all_tokens(p: Plan) -> float:
    """As many tokens as the listed sources hold, each used once."""
    return float(sum(p.tokens.values()))


def plan(counts: DataFrame, targets: DataFrame) -> Plan:
    """From the targets table, whose size is checked, and one row per listed source."""
    listed = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    supply = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    rows = listed.join(supply, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    rows = [r for r in rows if r["tokens"]]
    sum_ = sum(r["share"] for r in rows) or 1.0
    return Plan({r["source"]: r["share"] / sum_ for r in rows}, {r["source"]: max(0, int(r["r"])) for r in rows}, {r["source"]: r["tokens"] for r in rows}, {r["source"]: r["records"] for r in rows})


def mix(docs: DataFrame, targets: DataFrame, size, schedule=None, path: str | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """position (0..1), doc_id, source, repeat_no (from 1), tokens - in training order. `size` is a number of tokens or largest_exact or all_tokens."""
    spark = docs.sparkSession
    counts = materialise(token_counts(docs, path).where("tokens > 0"), "tokens")
    p = plan(counts, targets)
    total = float(size(p) if callable(size) else size)
    segs = _segments((schedule or tilted_schedule)(p.shares, p.repeats), total)
    seg = F.broadcast(spark.createDataFrame(segs, "source string, t0 double, t1 double, w0 double, w1 double, y0 double, y1 double"))
    rule = F.broadcast(
        spark.createDataFrame([(s, total * p.shares[s], p.repeats[s], p.tokens[s], 1 + p.records[s] // bucket_rows) for s in p.shares], "source string, demand double, max_repeats int, supply long, buckets int")
    )
    used = counts.join(rule, "source")
    used = used.withColumn("h", F.xxhash64("doc_id", F.lit(11))).withColumn("bucket", F.pmod("h", F.col("buckets")).cast("int"))
    sums = used.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).select("source", "bucket", "before")
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = used.withColumn("upto", F.sum("tokens").over(inner)).join(before, ["source", "bucket"])
    middle = F.col("before") + F.col("upto") - F.col("tokens") / 2
    passes = F.least(F.col("max_repeats") - 1, F.floor((F.col("demand") - middle) / F.col("supply"))).cast("int")
    rep = placed.withColumn("passes", passes).where("passes >= 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    rep = rep.withColumn("y", middle + F.col("pass") * F.col("supply"))
    at = rep.join(seg, "source").where("y >= y0 AND y < y1")
    out = at.select(_time_at(F.col("y")).alias("position"), "doc_id", "source", (F.col("pass") + 1).alias("repeat_no"), "tokens")
    return out.orderBy("position", "source", "doc_id", "repeat_no")


def shares_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target share, share reached, what is lacking, tokens, records, most uses of one record."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_records"), F.max("repeat_no").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    full = listed.join(got, "source", "left").na.fill(0, ["tokens", "n_records", "most_uses"])
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    return full.join(F.broadcast(total)).select("source", "target_share", "max_repeats", "tokens", "n_records", "most_uses", F.round(share, 6).alias("actual_share"), F.round(F.greatest(F.lit(0.0), F.col("target_share") - share), 6).alias("shortfall"))
