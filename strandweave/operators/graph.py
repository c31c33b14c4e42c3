"""The property graph as DataFrames: vertices, edges, one-hop patterns, and upserts as aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.sources.tables import ref_id

KEPT_SUPPORT = 100
WEIGHT_TAIL = 64  # older assertions weigh less than 2 ** -64


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame


def living(df: DataFrame) -> DataFrame:
    """The rows of ids that no row marks as deleted. Rows that repeat an id stay: only the dead ids are looked up, wide columns aren't moved."""
    dead = df.where("deleted_at IS NOT NULL AND id IS NOT NULL").select("id").distinct()
    return df.drop("deleted_at").where("id IS NOT NULL").join(dead, "id", "left_anti")


def live(df: DataFrame) -> DataFrame:
    """One row per id; none for an id that any row marks as deleted. Moves the columns that are asked for: for vectors and texts see `living`."""
    cols = [F.first(c).alias(c) for c in df.columns if c not in ("id", "deleted_at")]
    return df.where("id IS NOT NULL").groupBy("id").agg(*cols, F.count("deleted_at").alias("__dead")).where("__dead = 0").drop("__dead")


def edges(rel: DataFrame) -> DataFrame:
    """edge_rows with one row per id."""
    return edge_rows(rel.groupBy("id").agg(*[F.first(c).alias(c) for c in ("src_id", "dst_id", "predicate", "ontology_axis", "base_weight", "support_propositions", "source_id")]))


def edge_rows(rel: DataFrame) -> DataFrame:
    """id, src, dst, predicate, axis, base_weight, support, source_id: dangling null ends left out. Rows that repeat an id stay."""
    return rel.where("src_id IS NOT NULL AND dst_id IS NOT NULL").select(
        "id",
        ref_id("src_id").alias("src"),
        ref_id("dst_id").alias("dst"),
        "predicate",
        F.col("ontology_axis").alias("axis"),
        F.coalesce("base_weight", F.lit(0.0)).alias("base_weight"),
        F.transform(F.filter("support_propositions", lambda x: x.isNotNull()), ref_id).alias("support"),
        "source_id",
    )


def bound_edges(g: PropertyGraph) -> DataFrame:
    """Edges with both vertices bound; an edge to a vertex that isn't there matches nothing."""
    v = g.vertices.select(F.col("id").alias("v"), "name")
    s, d = v.withColumnsRenamed({"v": "src", "name": "src_name"}), v.withColumnsRenamed({"v": "dst", "name": "dst_name"})
    return g.edges.join(s, "src").join(d, "dst")


def one_hop(seeds: DataFrame, e: DataFrame, cap: int = 2048, source_id: str | None = None, scoped: bool = False) -> DataFrame:
    """seeds(qid, id) -> edges with a seed at either end, per question at most `cap`, heaviest first. With `scoped`, seeds have a
    source_id too, only edges of the same source count, and the cap holds per question and source.

    Two equi-joins and a distinct in place of a join on OR; the cap keeps a hub's edges from a single task (each task
    passes on at most `cap` per question)."""
    if source_id is not None:
        e = e.where(F.col("source_id") == source_id)
    by = ["source_id"] if scoped else []
    s = seeds.select("qid", "id", *by).distinct()
    touched = e.join(s.withColumnRenamed("id", "src"), ["src", *by]).select("qid", *e.columns)
    touched = touched.unionByName(e.join(s.withColumnRenamed("id", "dst"), ["dst", *by]).select("qid", *e.columns)).dropDuplicates(["qid", "id", *by])
    w = W.partitionBy("qid", *by).orderBy(F.desc("base_weight"), "src", "dst", "predicate", "id")
    return touched.withColumn("edge_no", F.row_number().over(w)).where(F.col("edge_no") <= cap)


def hops(seeds: DataFrame, e: DataFrame, n: int, cap: int = 2048, scoped: bool = False) -> DataFrame:
    """n-hop neighbourhood: the vertices reached so far are the next hop's seeds."""
    by = ["source_id"] if scoped else []
    out = one_hop(seeds, e, cap, scoped=scoped)
    for _ in range(n - 1):
        reached = out.select("qid", *by, F.explode(F.array("src", "dst")).alias("id")).distinct()
        out = one_hop(reached, e, cap, scoped=scoped)
    return out


# ---------------------------------------------------------------- upserts


def base_weight(confidence: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.5) * confidence)


def fold_weight(assertions: DataFrame, keys: list[str], seq: list[str], value: str) -> DataFrame:
    """The fold w <- (w + b) / 2 over a key's assertions in order, in closed form: b_i counts 2^-(n - i + [i > 1]).

    Only the last assertions count in double precision, so a hot key sends a bounded number of rows to its task."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in seq])
    last = assertions.select(*keys, *seq, value).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= WEIGHT_TAIL)
    n = F.max("__r").over(W.partitionBy(*keys))
    part = F.col(value) * F.pow(F.lit(0.5), F.col("__r") - 1 + F.when(F.col("__r") == F.col("__n"), 0).otherwise(1))
    return last.withColumn("__n", n).groupBy(*keys).agg(F.sum(part).alias("base_weight"))


def vote_axis(assertions: DataFrame, keys: list[str], seq: list[str], axis: str) -> DataFrame:
    """The most frequent axis; of several the latest assertion's if it is among them, else the one seen first; and all counts."""
    s = F.struct(*seq)
    by = assertions.groupBy(*keys, axis).agg(F.count(F.lit(1)).cast("int").alias("c"), F.min(s).alias("first"), F.max(s).alias("last"))
    top = by.groupBy(*keys).agg(
        F.max("c").alias("top"), F.max(F.struct("last", axis, "c")).alias("now"), F.min(F.struct((-F.col("c")).alias("n"), "first", axis)).alias("lead"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(axis, "c")))).alias("axis_counts")
    )
    return top.select(*keys, F.when(F.col("now.c") == F.col("top"), F.col(f"now.{axis}")).otherwise(F.col(f"lead.{axis}")).alias("axis"), "axis_counts")


def keep_support(assertions: DataFrame, keys: list[str], seq: list[str], pid: str) -> DataFrame:
    """Supporting propositions without repeats, in order of first appearance, the last 100."""
    first = assertions.where(F.col(pid).isNotNull()).groupBy(*keys, pid).agg(F.min(F.struct(*seq)).alias("first"))
    w = W.partitionBy(*keys).orderBy(F.desc("first"))
    last = first.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= KEPT_SUPPORT)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col(pid).alias("p"))))
    return last.groupBy(*keys).agg(ordered.alias("x")).select(*keys, F.transform("x", lambda y: y["p"]).alias("support"))


def upsert_edges(assertions: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """assertions(*keys, *seq, axis, confidence, proposition_id, source_id) -> one edge per key."""
    a = assertions.withColumn("b", base_weight(F.col("confidence")))
    n = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_assertions"), F.max_by("source_id", F.struct(*seq)).alias("source_id"), F.min_by("b", F.struct(*seq)).alias("first_b"))
    return n.join(fold_weight(a, keys, seq, "b"), keys).join(vote_axis(a, keys, seq, "axis"), keys).join(keep_support(a, keys, seq, "proposition_id"), keys, "left")


def merge_weight(old: Column, fold: Column, n: Column, first_b: Column) -> Column:
    """An existing weight with n further assertions: their own fold counts the first of them once more than it does behind an older weight."""
    half = F.pow(F.lit(0.5), n)
    return old * half + fold - first_b * half


EDGE_STATE = ("n_assertions", "source_id", "base_weight", "axis", "axis_counts", "support")


def merge_edges(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing edges with newly folded ones: w * 2^-n + fold, votes added, support appended; the latest source stays."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("n_assertions", "source_id", "base_weight", "axis", "axis_counts", "support")])
    b = o.join(new.select(*keys, "n_assertions", "source_id", "base_weight", "axis", "axis_counts", "support", "first_b"), keys, "full")
    n = F.coalesce("n_assertions", F.lit(0))
    added = merge_weight(F.col("o_base_weight"), F.col("base_weight"), n, F.col("first_b"))
    weight = F.when(F.col("o_n_assertions").isNull(), F.col("base_weight")).when(n == 0, F.col("o_base_weight")).otherwise(added)
    counts = F.map_zip_with(F.coalesce("o_axis_counts", F.create_map().cast("map<string,int>")), F.coalesce("axis_counts", F.create_map().cast("map<string,int>")), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    none = F.array().cast("array<string>")
    support = F.reverse(F.slice(F.reverse(F.array_distinct(F.concat(F.coalesce("o_support", none), F.coalesce("support", none)))), 1, KEPT_SUPPORT))
    out = b.select(*keys, (F.coalesce("o_n_assertions", F.lit(0)) + n).cast("long").alias("n_assertions"), F.coalesce("source_id", "o_source_id").alias("source_id"), weight.alias("base_weight"), F.coalesce("axis", "o_axis").alias("cur"), counts.alias("axis_counts"), support.alias("support"))
    top = F.array_max(F.map_values("axis_counts"))
    lead = F.get(F.map_keys(F.map_filter("axis_counts", lambda k, v: v == top)), F.lit(0))
    return out.withColumn("axis", F.when(F.element_at("axis_counts", F.col("cur")) == top, F.col("cur")).otherwise(lead)).select(*keys, "n_assertions", "source_id", "base_weight", "axis", "axis_counts", "support")


def upsert_entities(mentions: DataFrame, seq: list[str], existing: DataFrame | None = None) -> DataFrame:
    """mentions(name, source_id, *seq) -> id, name, kind, mention_count, source_id: by lower-cased name; the first
    spelling stays, the last source wins, the count grows with every mention but the first."""
    s = F.struct(*seq)
    new = mentions.where("name IS NOT NULL").groupBy(F.lower("name").alias("key")).agg(F.min_by("name", s).alias("name"), F.max_by("source_id", s).alias("source_id"), F.count(F.lit(1)).alias("n"))
    new = new.select("key", "name", "source_id", "n", F.lit("concept").alias("kind"))
    if existing is None:
        return new.select(F.md5("key").alias("id"), "name", "kind", (F.col("n") - 1).alias("mention_count"), "source_id")
    old = existing.select(F.lower("name").alias("key"), F.col("id").alias("oid"), F.col("name").alias("oname"), F.col("kind").alias("okind"), F.col("mention_count").alias("on"), F.col("source_id").alias("osrc"))
    both = old.join(new, "key", "full")
    return both.select(
        F.coalesce("oid", F.md5("key")).alias("id"),
        F.coalesce("oname", "name").alias("name"),
        F.when(F.col("oid").isNull(), F.col("kind")).otherwise(F.col("okind")).alias("kind"),
        F.when(F.col("oid").isNull(), F.col("n") - 1).otherwise(F.col("on") + F.coalesce("n", F.lit(0))).alias("mention_count"),
        F.coalesce("source_id", "osrc").alias("source_id"),
    )
