"""Incremental ingestion on Structured Streaming: ledgered ingest, running edge state, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import graph
from strandweave.session import scratch_path


def file_stream(spark: SparkSession, path: str, max_files: int = 4) -> DataFrame:
    """A stream over Parquet files: the schema is taken from what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def as_files(df: DataFrame, n: int) -> str:
    """df as n files in the shared folder, to be streamed."""
    path = scratch_path(df.sparkSession, "stream-in")
    df.repartition(n).write.parquet(path)
    return path


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], offsets: str) -> None:
    """Works off what is there; a run that is started again with the same `offsets` goes on behind the last batch that was complete."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    q.awaitTermination()


LEDGER = "span_hash string, doc_id string, section_path string"


def ingest_stream(spark: SparkSession, source: str, out: str, max_files: int = 2) -> DataFrame:
    """The spans in files below `source` arrive in micro-batches; only hashes that the ledger below `out` lacks are written to it. A batch's rows lie in a folder
    named by its number, so a batch that runs twice writes once. A restart on the same paths takes what has come since; of the ledger a batch reads
    the folders of the 256 hash prefixes that its own hashes have."""
    prefix = F.conv(F.substring("span_hash", 1, 2), 16, 10).cast("int")

    def ledger(session: SparkSession) -> DataFrame:
        try:
            return session.read.schema(f"{LEDGER}, batch int, part int").parquet(out + "/ledger")
        except AnalysisException:
            return session.createDataFrame([], f"{LEDGER}, batch int, part int")

    def sink(batch: DataFrame, n: int) -> None:
        fresh = batch.where("span_hash IS NOT NULL").dropDuplicates(["span_hash"]).withColumn("part", F.coalesce(prefix, F.lit(-1)))
        hit = [r[0] for r in fresh.select("part").distinct().collect()]  # at most 257
        done = ledger(batch.sparkSession).where((F.col("batch") != n) & F.col("part").isin(hit)).select("span_hash")
        fresh.join(done, "span_hash", "left_anti").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/ledger/batch={n}")

    run_to_end(file_stream(spark, source, max_files), sink, out + "/offsets")
    return ledger(spark)


def edge_state_stream(spark: SparkSession, source: str, out: str, keys: list[str], seq: list[str], max_files: int = 1000) -> DataFrame:
    """Running state per edge key: weight fold, votes, support and count. What comes later must follow in the order of `seq`; files that
    are there together go into one micro-batch of up to `max_files`. Each micro-batch is folded on its own and merged
    into the state; version n is made from version n - 1, so a batch that runs twice gives the same state, and a restart goes on from the last."""
    try:
        versions = [r[0] for r in spark.read.parquet(f"{out}/state").select("v").distinct().collect()]
    except AnalysisException:
        versions = []
    last = {"n": max(versions, default=-1)}

    def sink(batch: DataFrame, n: int) -> None:
        new = graph.upsert_edges(batch, keys, seq)
        if n:
            new = graph.merge_edges(batch.sparkSession.read.parquet(f"{out}/state/v={n - 1}"), new, keys)
        new.select(*keys, *graph.EDGE_STATE).write.mode("overwrite").parquet(f"{out}/state/v={n}")
        last["n"] = n

    run_to_end(file_stream(spark, source, max_files), sink, out + "/offsets")
    return spark.read.parquet(f"{out}/state/v={last['n']}")


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Tumbling windows over event time with a watermark; works on streams and tables."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.where("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, size: str = "2 hours", every: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size, every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def windows_by_stream(spark: SparkSession, events: DataFrame, files: int = 4) -> DataFrame:
    """The tumbling counts, computed by a stream in complete mode into a table."""
    out = scratch_path(spark, "windows")
    stream = file_stream(spark, as_files(events, files), 2)
    agg = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    q = (
        agg.select(F.col("w.start").alias("start"), "event_type", "n")
        .writeStream.outputMode("complete")
        .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", scratch_path(spark, "windows-offsets"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)
