"""From ranked propositions to a cited answer: budget, prompt, citations; and the finetuning export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.axes import NO_INFO
from strandweave.sources.tables import ref_id

# Scaffold and per-proposition allowances in characters, characters per token.
SCAFFOLD, PER_PROPOSITION, CHARS_PER_TOKEN = 200, 100, 4
# How citations are written, and the phrases of finetuning prompts.
MARK, NUMBER = r"\[(P\d+(?:\s*[,;]\s*P\d+)*)\]", r"P(\d+)"
LEAD, ASK, STATE = "Answer this question grounded in the corpus: ", "What does the corpus say about ", "State the fact: "


def within_budget(fetched: DataFrame, questions: DataFrame, budget_tokens: int = 4000) -> DataFrame:
    """The longest prefix in rank order that fits; the first proposition always stays."""
    q = questions.select("qid", F.length("question").alias("q_len"))
    w = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    cost = F.col("q_len") + SCAFFOLD + F.sum(F.coalesce(F.length("text"), F.lit(0)) + PER_PROPOSITION).over(w)
    rows = fetched.join(q, "qid").withColumn("cost", cost).withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("rank")))
    return rows.where((F.col("cost") <= budget_tokens * CHARS_PER_TOKEN) | (F.col("n") == 1))


def answer_prompts(kept: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, n_propositions, prompt: numbered propositions; the fixed sentence where there are none."""
    line = F.concat(F.lit("[P"), F.col("n").cast("string"), F.lit("] ("), F.coalesce("source_doc", F.lit("")), F.lit("#"), F.coalesce("source_span", F.lit("")), F.lit(") "), F.coalesce("text", F.lit("")))
    rows = kept.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_propositions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("evidence")
    )
    head = "Use only the numbered propositions and cite each claim by its mark.\n"
    full = F.concat(F.lit(head), F.col("evidence"), F.lit("\nQuestion: "), F.col("question"))
    return questions.select("qid", "question").join(rows, "qid", "left").select("qid", F.coalesce("n_propositions", F.lit(0)).cast("long").alias("n_propositions"), F.when(F.col("n_propositions").isNull(), F.lit(NO_INFO)).otherwise(full).alias("prompt"))


def citations(answers: DataFrame, n: str = "n_propositions") -> DataFrame:
    """qid, mark_no, part_no, cited: the numbers in [P1], [P1, P2; P3] in order, repeats kept, numbers beyond n dropped."""
    marks = F.regexp_extract_all("answer", F.lit(MARK), F.lit(1))
    one = answers.select("qid", F.col(n).alias("n"), F.posexplode(marks).alias("i", "m"))
    num = one.select("qid", "n", "i", F.posexplode(F.regexp_extract_all("m", F.lit(NUMBER), F.lit(1))).alias("j", "d"))
    num = num.select("qid", F.col("i").alias("mark_no"), F.col("j").alias("part_no"), F.try_to_number("d", F.lit("9" * 18)).cast("long").alias("cited"), "n")
    return num.where((F.col("cited") >= 1) & (F.col("cited") <= F.col("n"))).select("qid", "mark_no", "part_no", "cited")


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def supporting_edges(propositions: DataFrame, e: DataFrame) -> DataFrame:
    """Adds n_edges, said (the first edge's predicate in order of src, dst, predicate, id, of those that have one), axes and predicates (sorted, without repeats): of
    a proposition's supporting edges. All of them combine on the map side, so one that many edges support costs one row a task."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    s = e.select(F.explode(F.array_distinct("support")).alias("pid"), "src", "dst", "predicate", "axis", F.col("id").alias("eid")).dropDuplicates(["pid", "eid"])
    first = F.min(F.when(named("predicate").isNotNull(), F.struct("src", "dst", "predicate", "eid")))["predicate"]
    by = s.groupBy("pid").agg(F.count(F.lit(1)).alias("n_edges"), first.alias("said"), F.array_sort(F.collect_set(named("axis"))).alias("axes"), F.array_sort(F.collect_set(named("predicate"))).alias("predicates"))
    out = propositions.join(by, ref_id(F.col("id")) == F.col("pid"), "left").drop("pid")
    none = F.array().cast("array<string>")
    return out.withColumns({"n_edges": F.coalesce("n_edges", F.lit(0)), "axes": F.coalesce("axes", none), "predicates": F.coalesce("predicates", none)})


def training_examples(with_edges: DataFrame, lead: str = LEAD) -> DataFrame:
    """id, source, source_id, prompt, completion, axes, predicates."""
    text = F.coalesce("text", F.lit(""))
    short = F.concat(F.regexp_replace(F.left(text, F.lit(60)), r"\.+$", ""), F.when(F.length(text) > 60, "...").otherwise(""))
    return with_edges.select(
        "id",
        F.concat(F.coalesce("source_doc", F.lit("")), F.lit("#"), F.coalesce("source_span", F.lit(""))).alias("source"),
        F.coalesce("source_id", F.lit("default")).alias("source_id"),
        F.coalesce(F.concat(F.lit(lead), F.lit(ASK), F.col("said"), F.lit("?")), F.concat(F.lit(STATE), short)).alias("prompt"),
        text.alias("completion"),
        "axes",
        "predicates",
    )
