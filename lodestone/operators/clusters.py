"""Clusters of vectors and summary trees over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.quality import at_ranks
from lodestone.sources.shared import written


def _unit(f: pd.DataFrame) -> np.ndarray:
    x = np.stack(f["v"].to_numpy())
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def by_threshold(vectors: DataFrame, group: Column, least: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding", lot: int = 5000) -> DataFrame:
    """(group, id, cluster). Greedy clusters: in order of id, a vector not yet taken starts a cluster and takes all later
    ones with that cosine.

    Runs in each group, in rounds: the first `lot` rows by id that no earlier seed has taken are settled among themselves,
    and their seeds then take what they can of the group's other rows, which are dealt to lots so that no task holds an
    unbounded group. Which id is the last of the first `lot` is found by ranges, so that no task sorts a group. Clusters are the
    same at every lot. Groups of up to `lot` rows need one round; a larger one needs as many as its seeds fill lots, each with
    a few jobs when this is called.
    """
    rows = vectors.select(group.alias("group"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    lots = rows.groupBy("group").agg(F.ceil(F.count("*") / lot).alias("lots"))
    kind = rows.schema["group"].dataType.simpleString()

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        x = _unit(f)
        taken = np.full(len(x), -1)
        for i in range(len(x)):
            if taken[i] < 0:
                free = np.flatnonzero(taken < 0)
                taken[free[(free >= i) & ((x[free] * x[i]).sum(1) >= least)]] = i
                taken[i] = i
        seeds = [v if t == i else None for i, (t, v) in enumerate(zip(taken, f["v"]))]
        return pd.DataFrame({"group": f["group"], "id": f["id"], "cluster": f["id"].to_numpy()[taken], "v": seeds})

    def take(rest: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        rest = rest[rest["id"] > seeds["last"].iloc[0]] if len(seeds) else rest
        cluster = pd.array([None] * len(rest), dtype="Int64")
        if len(rest) and len(seeds):
            x, free = _unit(rest), np.arange(len(rest))
            seeds = seeds.sort_values("id", kind="stable")
            for i, v in zip(seeds["id"], _unit(seeds)):
                hit = (x[free] * v).sum(1) >= least
                cluster[free[hit]] = i
                free = free[~hit]
        return pd.DataFrame({"group": rest["group"], "lot": rest["lot"], "id": rest["id"], "v": rest["v"], "cluster": cluster})

    def first(rest: DataFrame, all_of_it: bool) -> DataFrame:
        own = rest.select("group", "id", "v")
        if not all_of_it:
            edges = at_ranks(own.select("group", "id"), "group", ["id"], {"edge": F.least(F.col("n"), F.lit(lot)) - 1}).select("group", "edge")
            own = own.join(edges, "group").where("id <= edge").drop("edge")
        return own.groupBy("group").applyInPandas(settle, f"group {kind}, id long, cluster long, v array<double>")

    rest = rows.join(F.broadcast(lots), "group").withColumn("lot", F.pmod(F.xxhash64("id"), "lots")).select("group", "lot", "id", "v")
    if not lots.where("lots > 1").limit(1).count():
        return first(rest, True).select("group", "id", "cluster")
    out = None
    while out is None or rest.limit(1).count():
        head = written(first(rest, False))
        last = head.groupBy("group").agg(F.max("id").alias("last"))
        seeds = head.where("v is not null").join(F.broadcast(last), "group").join(F.broadcast(lots), "group")
        seeds = seeds.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), "id", "v", "last")
        met = written(rest.groupBy("group", "lot").cogroup(seeds.groupBy("group", "lot")).applyInPandas(take, f"group {kind}, lot long, id long, v array<double>, cluster long"))
        found = head.select("group", "id", "cluster").unionByName(met.where("cluster is not null").select("group", "id", "cluster"))
        out = found if out is None else out.unionByName(found)
        rest = met.where("cluster is null").drop("cluster")
    return out


def mixture(vectors: DataFrame, k: int, dims: int = 15, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster) of a Gaussian mixture over the vectors' principal components."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    small = PCA(k=dims, inputCol="v", outputCol="features").fit(rows).transform(rows).select("id", "features")
    fitted = GaussianMixture(k=k, seed=seed, featuresCol="features", maxIter=20).fit(small)
    return fitted.transform(small).select("id", F.col("prediction").alias("cluster"))


def summary(contents: Column, most: int) -> Column:
    """Texts joined by spaces and cut to `most` characters at a sentence's end, else at a space, if past the half."""
    whole = F.array_join(contents, " ")
    cut = F.substring(whole, 1, most)
    at = lambda mark: F.when(F.contains(cut, F.lit(mark)), F.length(cut) - F.locate(mark[::-1], F.reverse(cut)) - (len(mark) - 1)).otherwise(-1)
    half, space = most // 2, at(" ")
    out = F.when(F.length(whole) <= most, whole)
    for mark in (". ", "! ", "? "):
        out = out.when(at(mark) > half, F.substring(cut, F.lit(1), at(mark) + 1))
    return out.when(space > half, F.concat(F.substring(cut, F.lit(1), space), F.lit("..."))).otherwise(F.concat(cut, F.lit("...")))


def tree(leaves: DataFrame, width: int, most: int, levels: int = 3, least: int = 5) -> DataFrame:
    """(level, node, parent, content): summary nodes over (node, content) leaves, `width` children a node in order of node,
    up to three levels, while a level has `least` nodes or more."""
    level, out = leaves.select(F.lit(0).alias("level"), F.col("node").cast("long").alias("node"), "content"), None
    for k in range(1, levels + 1):
        if level.limit(least).count() < least:
            break
        up = level.withColumn("parent", F.floor(F.col("node") / width))
        out = up if out is None else out.unionByName(up)
        ordered = F.array_sort(F.collect_list(F.struct("node", "content")))
        level = up.groupBy("parent").agg(ordered.alias("c")).select(F.lit(k).alias("level"), F.col("parent").alias("node"), summary(F.col("c.content"), most).alias("content"))
    top = level.withColumn("parent", F.lit(None).cast("long"))
    return top if out is None else out.unionByName(top)
