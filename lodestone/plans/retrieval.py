"""The whole retrieval as one plan: lexical and dense lists, fusion, gate, diversity, context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import questions, text
from lodestone.operators import lexical, ranking


@dataclass(frozen=True)
class Profile:
    """Switches and sizes of a retrieval; what is None follows the question."""

    expand: list[list[str]] | None = None
    dense: bool = True
    diverse: bool = True
    candidates: int = 15
    results: int = 5
    least: float = 0.0
    sparse_weight: float = 0.3
    balance: float = 0.4
    per_source: int = 2

    def over(self, **own) -> Profile:
        """The profile with a question's own switches; those that are None stay."""
        return Profile(**{**self.__dict__, **{k: v for k, v in own.items() if v is not None}})


def retrieve(asked: DataFrame, docs: DataFrame, topic: Column, dense: DataFrame | None = None, profile: Profile = Profile()) -> DataFrame:
    """query_id, pick, doc_id and mmr_score of each question's results.

    asked: (query_id, text); docs: (doc_id, text, source); dense: (query_id, doc_id, rank, score), from any vector search.
    """
    if profile.expand:
        asked = asked.withColumn("text", F.when(F.size(F.split("text", r"\s+")) >= 5, questions.expanded(F.col("text"), profile.expand)).otherwise(F.col("text")))
    found = lexical.search(asked, *lexical.index(docs, topic), profile.candidates)
    sparse = ranking.gated(found.select("query_id", "doc_id", "score"), "score", 0.0, profile.candidates)
    sparse = sparse.withColumn("rank", F.row_number().over(ranking.W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    weights = ranking.fusion_weights(profile.sparse_weight)
    lists = {"dense": (dense, weights["dense"])} if dense is not None and profile.dense else {}
    fused = ranking.fused(lists | {"sparse": (sparse, weights["sparse"] if lists else 1.0)})
    best = ranking.gated(fused.where(F.col("rank") <= profile.candidates), "rrf_score", profile.least, 1)
    rows = best.select("query_id", "doc_id", F.col("rrf_score").alias("score")).join(docs.select("doc_id", "source", "text"), "doc_id")
    rows = rows.select("query_id", "doc_id", "score", "source", text.word_set(F.col("text")).alias("words"))
    if profile.diverse:
        return ranking.diverse(rows, profile.results, profile.balance, profile.per_source)
    order = ranking.W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= profile.results)
    return rows.select("query_id", "doc_id", "pick", F.col("score").alias("mmr_score"))
