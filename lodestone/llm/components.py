"""Connected components of an edge table, by repeated least labels with pointer jumping.

Each round is a few joins and partial aggregates; its labels are written to the shared folder, so that lineage stays
short. A node with very many edges only ever meets partial minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tasks import written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of the edges (a, b); loops and repeats are allowed."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null and a != b")
    both = written(both.distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = written(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels, changed = new.select("node", "label"), new.where("was != label").limit(1).count()
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")
