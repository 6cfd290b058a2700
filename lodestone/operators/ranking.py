"""Rank fusion, gates, boosts and diversity over ranked lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def fused(lists: dict[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank, score) lists: the sum of weight / (k + rank). The score is that of
    the first list, in the order given, which has the document; n_lists: how many do."""
    parts = None
    for i, (name, (rows, weight)) in enumerate(lists.items()):
        part = rows.select("query_id", "doc_id", F.lit(i).alias("at"), (F.lit(weight) / (k + F.col("rank"))).alias("share"), F.col("score").cast("double").alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("share"), 8).alias("rrf_score"), F.min_by("score", "at").alias("score"), F.count("*").alias("n_lists"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "doc_id")))


def fusion_weights(sparse: float = 0.3, graph: float | None = None) -> dict[str, float]:
    """Weights of the lists: with a graph list 0.5, 0.3 and its own, else what the lexical list leaves."""
    return {"dense": 0.5, "sparse": 0.3, "graph": graph} if graph is not None else {"dense": 1 - sparse, "sparse": sparse}


def gated(rows: DataFrame, score: str, least: float, otherwise: int) -> DataFrame:
    """Rows with at least the score; for a query that has none, its `otherwise` best."""
    by = W.partitionBy("query_id")
    out = rows.withColumn("_any", F.max(F.col(score) >= least).over(by)).withColumn("_n", F.row_number().over(by.orderBy(F.desc(score), "doc_id")))
    return out.where(F.when(F.col("_any"), F.col(score) >= least).otherwise(F.col("_n") <= otherwise)).drop("_any", "_n")


def boosted(rows: DataFrame, score: str, text: Column, query_text: Column, keywords: list[str], factor: float = 0.1) -> DataFrame:
    """Adds factor * min(matches, 3) / 3 where the query itself has one of the keywords."""
    words = F.array(*map(F.lit, keywords))
    count = lambda t: F.size(F.filter(words, lambda w: F.contains(F.lower(t), w)))
    add = F.when(count(query_text) > 0, F.least(count(text), F.lit(3)) / 3 * factor).otherwise(0.0)
    return rows.withColumn("boosted", F.round(F.col(score) + add, 6))


def merged_summary(direct: DataFrame, summary: DataFrame, weight: float = 0.3) -> DataFrame:
    """Scores of two lists (query_id, doc_id, score) as (1 - weight) and weight parts; a list without the row gives 0."""
    both = direct.select("query_id", "doc_id", F.col("score").alias("a")).join(summary.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", F.round(F.coalesce("a", F.lit(0.0)) * (1 - weight) + F.coalesce("b", F.lit(0.0)) * weight, 7).alias("score"))


def diverse(candidates: DataFrame, k: int, balance: float = 0.6, per_source: int = 2) -> DataFrame:
    """Maximal marginal relevance: query_id, doc_id, pick (from 1) and mmr_score. candidates: query_id, doc_id, score,
    source, words; a bounded list a query, as ranking leaves it, taken in order of score and id."""

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        low, span = f["score"].min(), f["score"].max() - f["score"].min()
        relevance = (f["score"] - low) / (span if span > 0 else 1.0)
        sets = [frozenset(w) for w in f["words"]]
        nearest, taken, used, out = [0.0] * len(f), set(), {}, []
        while len(out) < k:
            open_ = [i for i in range(len(f)) if i not in taken and used.get(f["source"][i], 0) < per_source]
            if not open_:
                break
            value = lambda i: balance * relevance[i] - (1 - balance) * nearest[i]
            best = max(open_, key=lambda i: (value(i), -i))
            out.append((f["query_id"][best], f["doc_id"][best], len(out) + 1, round(float(value(best)), 6)))
            taken.add(best)
            used[f["source"][best]] = used.get(f["source"][best], 0) + 1
            for i in open_:
                both = len(sets[i] & sets[best])
                union = len(sets[i]) + len(sets[best]) - both
                nearest[i] = max(nearest[i], both / union if sets[i] and sets[best] else 0.0)
        return pd.DataFrame(out, columns=["query_id", "doc_id", "pick", "mmr_score"])

    return candidates.select("query_id", "doc_id", "score", "source", "words").groupBy("query_id").applyInPandas(each, "query_id long, doc_id long, pick int, mmr_score double")
