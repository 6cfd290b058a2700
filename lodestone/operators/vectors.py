"""Exact nearest neighbours of a query set by cosine: numpy products inside tasks, Spark merges.

Queries are taken in blocks of bounded size; each task keeps the k best of its own rows for each query, so that what is
shuffled is k rows a query and task, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of a block, and rows that a task compares with a block at once: what a task holds doesn't grow with the tables.
BLOCK, ROWS = 4096, 512


def valid(vectors: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has the dimension and only finite numbers."""
    v = F.col(vector_col)
    return vectors.where(v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def last_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """An upsert's outcome: of the rows of a key the last alone."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length; 0 where a norm is below 1e-9."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / norms)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score (rounded to 6) and rank of each query's k nearest other rows, ties to the lesser id."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    spark = vectors.sparkSession
    blocks = -(-asked.count() // BLOCK)
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        held = block.toPandas()  # about BLOCK rows
        ids = held["query_id"].to_numpy()
        q = np.stack(held["v"].to_numpy()) if len(held) else np.zeros((0, 1))
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        sent = spark.sparkContext.broadcast((ids, q))

        def each(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            near = np.zeros((len(ids), 0), np.int64)  # the task's best so far, by id and score
            sims = np.zeros((len(ids), 0))
            for f in (frame.iloc[at : at + ROWS] for frame in frames for at in range(0, len(frame), ROWS)):
                if not len(ids):
                    continue
                x, own = np.stack(f["v"].to_numpy()), f["vec_id"].to_numpy()
                s = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).T, 6) + 0.0
                s[ids[:, None] == own[None, :]] = -np.inf
                if s.shape[1] > k:  # a batch's k best by score, and all that tie with the last of them
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    width = int((s >= least[:, None]).sum(1).max())
                    top = np.argpartition(-s, width - 1, axis=1)[:, :width] if width < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(ids), 1))
                    s, own = np.take_along_axis(s, top, 1), own[top]
                else:
                    own = np.tile(own, (len(ids), 1))
                near, sims = np.concatenate([near, own], axis=1), np.concatenate([sims, s], axis=1)
                best = np.lexsort((near, -sims), axis=1)[:, :k]
                near, sims = np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1)
            row, column = np.nonzero(sims > -np.inf)
            yield pd.DataFrame({"query_id": ids[row], "vec_id": near[row, column], "score": sims[row, column]})

        parts.append(rows.mapInPandas(each, "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
