"""Summary trees of vectors by topic, searched over all levels at once or level by level.

Leaves of a topic are numbered in order; WIDTH of them have a parent, and so on upwards while a topic has LEAST nodes or more on
a level. A node's vector is the mean of its leaves', from its children's means and numbers. A descent keeps the best
BEAM nodes of a level for each query and topic and meets their children alone, by an equi-join on the parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import vectors
from lodestone.operators.ordering import numbered
from lodestone.sources.shared import written

# Children of a node, levels, nodes of a level that get parents, and nodes kept on a descent.
WIDTH, LEVELS, LEAST, BEAM = 10, 3, 5, 3


def built(leaves: DataFrame, width: int = WIDTH, levels: int = LEVELS, least: int = LEAST) -> DataFrame:
    """(topic, level, node, parent, leaf, n, v) from leaves (topic, leaf, v): node counts from 0 on each level; parent is null on a
    topic's highest level; leaf is the id, on level 0."""
    rows = numbered(leaves.select("topic", "leaf", F.col("v").cast("array<double>").alias("v")), ["topic"], ["leaf"], "place")
    level = rows.select("topic", F.lit(0).alias("level"), (F.col("place") - 1).alias("node"), "leaf", F.lit(1).cast("long").alias("n"), "v")
    out = None
    for k in range(levels + 1):
        sizes = level.groupBy("topic").agg(F.count("*").alias("size"))
        more = level.join(sizes, "topic").withColumn("parent", F.when((F.col("size") >= least) & F.lit(k < levels), F.floor(F.col("node") / width))).drop("size")
        more = written(more)
        out = more if out is None else out.unionByName(more)
        # a parent has up to `width` children, folded inside a row
        own = F.array_sort(F.collect_list(F.struct("node", "n", "v")))
        up = more.where("parent is not null").groupBy("topic", "parent").agg(own.alias("own"), F.sum("n").alias("n"))
        zero = F.transform(F.col("own")[0]["v"], lambda x: F.lit(0.0))
        total = F.aggregate("own", zero, lambda s, c: F.zip_with(s, c["v"], lambda a, b: a + b * c["n"]))
        mean = F.transform(total, lambda x: x / F.col("n"))
        level = up.select("topic", F.lit(k + 1).alias("level"), F.col("parent").alias("node"), F.lit(None).cast("long").alias("leaf"), "n", mean.alias("v"))
        if k == levels or not up.limit(1).count():
            break
    return out.select("topic", "level", "node", "parent", "leaf", "n", "v")


def node_id() -> F.Column:
    """One number for each node of whole-number topics: a leaf's own id, below 0 for others."""
    return F.when(F.col("level") == 0, F.col("leaf")).otherwise(-(F.col("level") * F.lit(10**15) + F.col("topic") * F.lit(10**11) + F.col("node")))


def collapsed(nodes: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, node_id, score, rank): the nearest nodes of all levels and topics; not a query's own leaf. queries: vec_id, v."""
    rows = nodes.select(node_id().alias("vec_id"), "v")
    return vectors.nearest(rows, queries, top, "vec_id", "v").withColumnRenamed("vec_id", "node_id")


def descended(nodes: DataFrame, queries: DataFrame, top: int, beam: int = BEAM) -> DataFrame:
    """(query_id, topic, leaf, score, rank): from each topic's highest level the best `beam` nodes, then the best of their children,
    down to leaves; of these the `top` best of all topics. A query's own leaf isn't counted among leaves."""
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
    score = F.round(vectors.cosine(F.col("q"), F.col("v")), 6)
    by = W.partitionBy("query_id", "topic").orderBy(F.desc("score"), "node")
    best = lambda rows, n: rows.withColumn("score", score).withColumn("k", F.row_number().over(by)).where(F.col("k") <= n).drop("k")
    columns = ["query_id", "q", "topic", "level", "node", "leaf", "score"]
    own = F.coalesce(F.col("leaf") == F.col("query_id"), F.lit(False))
    # every query is asked in every topic; a topic's highest level has fewer nodes than LEAST, or is the last
    topics = F.broadcast(nodes.select("topic").distinct().agg(F.collect_list("topic").alias("topics")))
    in_topics = asked.crossJoin(topics).select("query_id", "q", F.explode("topics").alias("topic"))  # one row of topics
    front = best(in_topics.join(nodes.where("parent is null"), "topic").where(~own), beam).select(*columns)
    found = front.where("level = 0")
    for _ in range(LEVELS):
        front = written(front.where("level > 0"))
        if not front.limit(1).count():
            break
        below = nodes.select("topic", (F.col("level") + 1).alias("level"), F.col("parent").alias("node"), F.col("node").alias("child"), F.col("leaf").alias("child_leaf"), "v").where("node is not null")
        met = front.select("query_id", "q", "topic", "level", "node").join(below, ["topic", "level", "node"])
        met = met.select("query_id", "q", "topic", (F.col("level") - 1).alias("level"), F.col("child").alias("node"), F.col("child_leaf").alias("leaf"), "v").where(~own)
        front = best(met, beam).select(*columns)
        found = found.unionByName(front.where("level = 0"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "leaf"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "topic", "leaf", "score", "rank")
