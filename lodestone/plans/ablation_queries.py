"""Ablation of the retrieval's switches: fifteen sets over the same questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import questions, text
from lodestone.operators import evaluation, experiments, lexical, ranking
from lodestone.plans.answer_queries import _WANTED, _wanted
from lodestone.plans.more_queries import _SYNONYMS
from lodestone.plans.search_queries import _BM25, _KNN, _TOKENS, _index, _knn, _questions
from lodestone.registry import ORACLES, query, table
from lodestone.sources.shared import folder

RESULTS, CANDIDATES, PER_SOURCE = 5, 20, 2


def listed(stages: experiments.Stages, asked: DataFrame, dense: DataFrame, search, on: frozenset) -> DataFrame:
    """(query_id, doc_id, score): candidates of a set of switches. Questions are expanded before the lexical search alone, so that
    expansion counts only beside it."""
    if "use_hybrid" not in on:
        return stages.get("dense", {}, [], lambda: ranking.fused({"dense": (dense, 1.0)}).select("query_id", "doc_id", F.col("rrf_score").alias("score")))
    expansion = "use_expansion" in on
    wide = asked.withColumn("text", questions.expanded(F.col("text"), _SYNONYMS)) if expansion else asked
    sparse = stages.get("sparse", {"expansion": expansion}, [], lambda: search(wide))
    weights = ranking.fusion_weights()
    lists = {"dense": (dense, weights["dense"]), "sparse": (sparse, weights["sparse"])}
    return stages.get("fused", {}, [sparse], lambda: ranking.fused(lists).select("query_id", "doc_id", F.col("rrf_score").alias("score")))


def picked(rows: DataFrame, on: frozenset) -> DataFrame:
    """The best of candidates (query_id, doc_id, score, source, held): by how many of the question's words they hold if these are
    reranked; with diversity no more than PER_SOURCE of a source."""
    first = [F.desc("held")] if "rerank" in on else []
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*first, F.desc("score"), "doc_id")))
    if "apply_diversity" in on:
        rows = rows.withColumn("own", F.row_number().over(W.partitionBy("query_id", "source").orderBy("place"))).where(F.col("own") <= PER_SOURCE).drop("own")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= RESULTS)


def ablated(spark: SparkSession, sf_dir: str, at: str) -> tuple[DataFrame, experiments.Stages]:
    """(layer, config_id, composite, keyword, queries) of all sets, kept under a folder. Switches of a model (hypothetical answers,
    summaries, communities, entity graph) change nothing while no model or list is given for them; sets that differ in these
    alone read the same stages."""
    stages = experiments.Stages(spark, at, sf_dir)
    asked = _questions(spark, sf_dir)
    first = table(spark, sf_dir, "benchmark").agg(F.min("item_id")).first()[0]
    dense = stages.get("near", {}, [], lambda: _knn(spark, sf_dir, CANDIDATES).select((F.floor(F.col("query_id") / 50) + first).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = asked.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("words"))

    def search(wide: DataFrame) -> DataFrame:
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return lexical.search(wide, *_index(spark, sf_dir), CANDIDATES).select("query_id", "doc_id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= CANDIDATES)

    def scored(name: str, settings: dict) -> DataFrame:
        on = frozenset(k for k, v in settings.items() if v)
        candidates = listed(stages, asked, dense, search, on)
        rows = candidates.join(docs, "doc_id").join(words, "query_id").withColumn("held", F.size(F.filter("words", lambda w: F.contains(F.lower("text"), w)))).drop("words")
        own = {k: k in on for k in ("rerank", "apply_diversity")}
        metrics = stages.get("metrics", own, [candidates], lambda: evaluation.per_query(picked(rows, on).join(_wanted(spark, sf_dir), "query_id").withColumn("ms", F.col("query_id") % 20 * 50.0)))
        return metrics.agg(F.round(F.avg("composite"), 5).alias("composite"), F.round(F.avg("keyword"), 5).alias("keyword"), F.count("*").alias("queries"))

    configs = {name: {s: s in on for s in experiments.SWITCHES} for name, on in experiments.RETRIEVAL.items()}
    return experiments.run(spark, at, "retrieval", configs, scored), stages


_SETS = ", ".join(f"('{name}', '{'d' if 'use_hybrid' not in on else 'x' if 'use_expansion' in on else 'h'}', {'rerank' in on}, {'apply_diversity' in on})" for name, on in experiments.RETRIEVAL.items())
_EXPANDED = _BM25.strip().replace("FROM benchmark", f"FROM (SELECT item_id, expanded AS text FROM ({ORACLES['question_expansion']}))")


@query(f"""WITH near_ AS (WITH {_KNN.strip()} SELECT (SELECT min(item_id) FROM benchmark) + query_id // 50 AS query_id, vec_id AS doc_id, rank FROM near WHERE rank <= 20),
h_ AS (WITH {_BM25.strip()} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ranked WHERE rank <= 20), x_ AS (WITH {_EXPANDED} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ranked WHERE rank <= 20),
c AS (SELECT 'd' AS list, query_id, doc_id, round(1.0 / (60 + rank), 8) AS score FROM near_ UNION ALL SELECT list, query_id, doc_id, round(sum(share), 8) FROM (SELECT unnest(['h', 'x']) AS list, query_id, doc_id, 0.7 / (60 + rank) AS share FROM near_ UNION ALL SELECT 'h', query_id, doc_id, 0.3 / (60 + rank) FROM h_ WHERE rank <= 20 UNION ALL SELECT 'x', query_id, doc_id, 0.3 / (60 + rank) FROM x_ WHERE rank <= 20) GROUP BY list, query_id, doc_id),
t AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS words FROM benchmark),
{_WANTED}, r AS (SELECT list, c.query_id, c.doc_id, score, source, lower(d.text) AS body, len(list_filter(words, lambda w: contains(lower(d.text), w))) AS held FROM c JOIN documents d USING (doc_id) JOIN t USING (query_id)),
s AS (SELECT * FROM (VALUES {_SETS}) AS v(config_id, list, rerank, diverse)),
p AS (SELECT config_id, diverse, query_id, doc_id, source, body, row_number() OVER (PARTITION BY config_id, query_id ORDER BY CASE WHEN rerank THEN held ELSE 0 END DESC, score DESC, doc_id) AS place FROM r JOIN s USING (list)),
o AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id, source ORDER BY place) AS own FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY place) AS rank FROM o WHERE NOT diverse OR own <= 2),
l AS (SELECT config_id, k.query_id, rank, source, keywords, entities, list_filter(keywords, lambda w: contains(body, lower(w))) AS found, list_filter(entities, lambda w: contains(body, lower(w))) AS named FROM k JOIN kw USING (query_id) WHERE rank <= 5),
i AS (SELECT *, len(found) / len(keywords) AS rel, row_number() OVER (PARTITION BY config_id, query_id ORDER BY len(found) / len(keywords) DESC, rank) AS ideal FROM l),
m AS (SELECT config_id, query_id, len(list_distinct(flatten(list(found)))) / any_value(len(keywords)) AS keyword, len(list_distinct(flatten(list(named)))) / any_value(len(entities)) AS entity, coalesce(1 / min(CASE WHEN len(found) >= greatest(1, len(keywords) // 2) THEN rank END), 0.0) AS mrr, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(ideal + 1)) AS idcg, count(DISTINCT source) / count(*) AS diversity FROM i GROUP BY config_id, query_id)
SELECT config_id, round(avg(keyword * 0.35 + entity * 0.15 + mrr * 0.20 + CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END * 0.15 + diversity * 0.10 + 0.05 * (1 - (query_id % 20) * 50.0 / 2000)), 5) AS composite, round(avg(keyword), 5) AS keyword, count(*) AS queries FROM m GROUP BY config_id""")
def ablation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite of fifteen sets of switches. Stages that sets have in common are computed once."""
    rows, _ = ablated(spark, sf_dir, f"{folder(spark)}/lodestone-ablation-{uuid.uuid4().hex}")
    return rows.select("config_id", "composite", "keyword", "queries")
