"""The graph's tables in a folder: every ingest appends its rows below batch=N, and a log of Parquet rows says which batches are complete.

A table is read as the rows of complete batches, of those with a key the latest one. A batch that breaks off is not in the log and is written anew by
the next one. Nothing is rewritten."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.axes import AXES
from strandweave.operators import graph, ingest, vectors
from strandweave.session import materialise

EDGE_KEY = ["src", "dst", "predicate"]
SCHEMAS = {
    "entity": "id string, name string, kind string, embedding array<float>, mention_count long, source_id string, created_at timestamp",
    "proposition": "id string, text string, source_doc string, source_span string, embedding array<float>, source_id string, created_at timestamp",
    "rel": "src string, dst string, predicate string, n_assertions long, source_id string, base_weight double, axis string, axis_counts map<string,int>, support array<string>",
    "mentions": "proposition_id string, entity_id string, role string, confidence double",
    "axis": "axis_no int, axis string, vec array<float>",
    "ledger": "span_hash string, doc_id string, section_path string",
    "sources": "source_id string, folder string",
    "quarantine": "doc_id string, section_path string, error_type string, error_message string",
}
KEYS = {"entity": ["id"], "proposition": ["id"], "rel": EDGE_KEY, "sources": ["source_id"], "ledger": ["span_hash"], "axis": ["axis"]}
LOG = "n long, emptied string"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> list:
        try:
            return sorted(self.spark.read.schema(LOG).parquet(f"{self.root}/log").collect())  # one row a batch
        except AnalysisException:
            return []

    def commit(self, emptied: str | None = None, **tables: DataFrame) -> None:
        """Appends the rows of one batch, then its line in the log. `emptied`: a table, or `all`, whose earlier batches no longer count."""
        n = max([r["n"] for r in self._log()], default=-1) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={n}")
        self.spark.createDataFrame([(n, emptied)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def init(self, rebuild: bool = False) -> None:
        """The axes, where they are missing or all is to begin anew."""
        if rebuild or not self._log():
            self.commit("all", axis=vectors.axis_vectors(self.spark))

    def tables(self) -> list[str]:
        return sorted(SCHEMAS)

    def read(self, name: str) -> DataFrame:
        log = self._log()
        since = max([r["n"] for r in log if r["emptied"] in ("all", name)], default=-1)
        try:
            d = self.spark.read.schema(f"{SCHEMAS[name]}, batch long").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[name])
        d = d.where(F.col("batch").isin([r["n"] for r in log if r["n"] >= since]))
        if name not in KEYS:
            return d.drop("batch")
        rest = [c for c in d.columns if c not in KEYS[name] and c != "batch"]
        last = d.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest, F.lit(0).alias("__n")), "batch").alias("r"))
        return last.select(*[F.col(f"r.{c}") if c in rest else F.col(c) for c in d.columns if c != "batch"])

    def table(self, name: str) -> DataFrame:
        """entity, proposition and rel as the retrieval plans read them."""
        d = self.read(name)
        if name == "rel":
            return d.select(F.md5(F.concat_ws("|", *EDGE_KEY)).alias("id"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "predicate", F.col("axis").alias("ontology_axis"), "base_weight", F.col("support").alias("support_propositions"), "source_id")
        return d.withColumn("deleted_at", F.lit(None).cast("timestamp"))

    def clear_ledger(self) -> None:
        self.commit("ledger")

    def register_source(self, source_id: str, folder: str) -> None:
        new = self.spark.createDataFrame([(source_id, folder)], SCHEMAS["sources"]).join(self.read("sources"), "source_id", "left_anti")
        if not new.isEmpty():
            self.commit(sources=new)

    def sources(self) -> DataFrame:
        return self.read("entity").select("source_id").unionByName(self.read("proposition").select("source_id")).where("source_id IS NOT NULL").distinct().orderBy("source_id")

    def add_entities(self, rows: DataFrame) -> None:
        """rows(seq, name, kind, embedding, source_id), one or many, as one batch. A name that is known in whatever case counts its mentions up and takes the last
        embedding and source; name, kind and creation stay. Rows without a name are left out; seq is their order."""
        new = rows.where("name IS NOT NULL").groupBy(F.lower("name").alias("key")).agg(
            F.min_by(F.struct("name", "kind"), "seq").alias("a"), F.max_by(F.struct("embedding", "source_id"), "seq").alias("z"), F.count(F.lit(1)).alias("n")
        )
        old = self.read("entity").select(F.lower("name").alias("key"), F.struct("id", "name", "kind", "mention_count", "created_at").alias("o"))
        known = F.col("o").isNotNull()
        first = lambda c: F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        count = F.when(known, F.col("o.mention_count") + F.col("n")).otherwise(F.col("n") - 1).alias("mention_count")
        up = new.join(old, "key", "left").select(F.coalesce("o.id", F.md5("key")).alias("id"), first("name"), first("kind"), "z.embedding", count, "z.source_id", F.coalesce("o.created_at", F.current_timestamp()).alias("created_at"))
        self.commit(entity=materialise(up, "entities"))

    def add_propositions(self, rows: DataFrame) -> None:
        """rows(seq, text, source_doc, source_span, embedding, source_id). The id is made of all but the embedding, so a row that is sent again is the same proposition."""
        pid = ingest.proposition_id(*[F.col(c) for c in ("source_id", "source_doc", "source_span", "text", "seq")]).alias("id")
        self.commit(proposition=rows.where("text IS NOT NULL").select(pid, "text", "source_doc", "source_span", "embedding", "source_id", F.current_timestamp().alias("created_at")).dropDuplicates(["id"]))

    def add_edges(self, rows: DataFrame) -> None:
        """rows(seq, src, dst, predicate, axis, base_weight, proposition_id, source_id): assertions of edges between entity ids, folded in order of seq onto what is
        there. Rows that lack an end, a predicate or a weight are left out."""
        a = rows.where("src IS NOT NULL AND dst IS NOT NULL AND predicate IS NOT NULL AND base_weight IS NOT NULL").withColumn("confidence", F.col("base_weight") * 2 - 1)
        new = materialise(graph.upsert_edges(a, EDGE_KEY, ["seq"]), "edges")
        self.commit(rel=materialise(graph.merge_edges(self.read("rel").join(new.select(*EDGE_KEY), EDGE_KEY, "left_semi"), new, EDGE_KEY), "rel"))

    def add_to_ledger(self, rows: DataFrame) -> None:
        """rows(span_hash, doc_id, section_path); hashes that are there already change nothing."""
        new = ingest.ledger_insert(self.read("ledger"), rows.withColumn("span_hash", F.lower("span_hash")))
        self.commit(ledger=new.select("span_hash", "doc_id", "section_path"))

    def ingest(self, units: DataFrame, spans: DataFrame, quarantine: DataFrame | None = None) -> None:
        """units(unit_id, source_id, doc_id, section_path, span_hashes, propositions, received_at) and the spans(hash, doc_id, section_path) they are made of, as one batch.

        Units all of whose spans are in the ledger are left out, so the same units twice change nothing. Every proposition is kept, with or without triples; triples
        with an unknown axis or a confidence outside 0..1 are not. Edges run between entity ids."""
        led = self.read("ledger")
        units = materialise(ingest.not_in_ledger(units.dropDuplicates(["unit_id"]), led, "unit_id"), "units")
        at = F.coalesce("received_at", F.lit("1970-01-01").cast("timestamp")).alias("at")
        pid = ingest.proposition_id(*[F.col(c) for c in ("source_id", "doc_id", "section_path", "text", "prop_no")])
        p = units.select("source_id", "doc_id", "section_path", F.posexplode("propositions").alias("i", "p")).where("p IS NOT NULL")
        p = p.select("source_id", "doc_id", "section_path", F.col("p.text").alias("text"), (F.col("i") + 1).alias("prop_no")).withColumn("id", pid).dropDuplicates(["id"])
        p = p.join(self.read("proposition").select("id"), "id", "left_anti")
        props = vectors.embed(p, "text", "embedding").select("id", "text", F.col("doc_id").alias("source_doc"), F.col("section_path").alias("source_span"), "embedding", "source_id", F.current_timestamp().alias("created_at"))
        t = ingest.triples(units).where("subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL AND confidence BETWEEN 0 AND 1").where(F.col("ontology_axis").isin(*AXES)).withColumn("pid", pid)
        seen = units.select("unit_id", "source_id", at)
        said = ingest.surfaces(t).withColumnRenamed("surface", "name").join(seen, "unit_id")
        old = self.read("entity")
        touched = old.withColumn("key", F.lower("name")).join(said.select(F.lower("name").alias("key")).distinct(), "key", "left_semi").drop("key")
        up = graph.upsert_entities(said, ["at", "unit_id", "first_pos"], touched)
        up = up.join(touched.select("id", "embedding", "created_at"), "id", "left")
        up = vectors.embed(up, "name", "__v").withColumns({"embedding": F.coalesce("embedding", "__v"), "created_at": F.coalesce("created_at", F.current_timestamp())})
        entity = materialise(up.select("id", "name", "kind", "embedding", F.col("mention_count").cast("long").alias("mention_count"), "source_id", "created_at"), "entities")
        r = materialise(ingest.resolve(t.drop("src_id", "dst_id"), entity), "resolved")
        a = r.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "predicate", F.col("ontology_axis").alias("axis"), "confidence", F.col("pid").alias("proposition_id"), "source_id", at, "unit_id", "prop_no", "triple_no")
        new = graph.upsert_edges(a, EDGE_KEY, ["at", "unit_id", "prop_no", "triple_no"])
        rel = graph.merge_edges(self.read("rel").join(new.select(*EDGE_KEY), EDGE_KEY, "left_semi"), new, EDGE_KEY)
        ends = [r.select(F.col("pid").alias("proposition_id"), F.col(c).alias("entity_id"), F.lit(role).alias("role"), "confidence") for c, role in (("src_id", "subject"), ("dst_id", "object"))]
        mentions = ends[0].unionByName(ends[1]).groupBy("proposition_id", "entity_id", "role").agg(F.max("confidence").alias("confidence"))
        more = ingest.ledger_insert(led, spans.select(F.lower("hash").alias("span_hash"), "doc_id", "section_path"))
        extra = {} if quarantine is None else {"quarantine": quarantine.select("doc_id", "section_path", "error_type", "error_message")}
        self.commit(entity=entity, proposition=props, rel=rel, mentions=mentions, ledger=more.select("span_hash", "doc_id", "section_path"), **extra)
