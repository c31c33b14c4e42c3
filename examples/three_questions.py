"""Three questions that lean on different axes: their answers, how each activates the axes, and the subgraph each one used.

    python examples/three_questions.py TABLES OUT [QUESTION ...]

TABLES is a folder of tables. OUT gets amplitudes (CSV, a row per question and a column per axis), nodes and edges (JSON lines, sized for drawing)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from strandweave.axes import AXES
from strandweave.operators import complete, retrieve
from strandweave.plans.retrieval import Retrieval, prompts
from strandweave.session import local_session

QUESTIONS = ["What causes a checkpoint to stall?", "What is a partition map?", "When was the redo stream replaced?"]


def run(spark, tables: str, out: str, questions: list[str]) -> None:
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions, 1)], "qid string, question string")
    r = Retrieval(spark, tables, asked)
    a = retrieve.settle_degenerate(r.amplitudes).groupBy("qid").pivot("axis", list(AXES)).agg(F.round(F.first("amplitude"), 3))
    asked.join(a, "qid").orderBy("qid").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/amplitudes")
    r.activations.select("qid", "node", (F.greatest("activation", F.lit(0.01)) * 100).alias("size")).write.mode("overwrite").json(f"{out}/nodes")
    r.weighted.select("qid", "src", "dst", "axis", (F.greatest("weight", F.lit(0.01)) * 10).alias("width")).write.mode("overwrite").json(f"{out}/edges")
    asked.join(complete.answers(prompts(r)), "qid").select("question", "answer").orderBy("qid").show(len(questions), False)


if __name__ == "__main__":
    run(local_session(), sys.argv[1], sys.argv[2], sys.argv[3:] or QUESTIONS)
