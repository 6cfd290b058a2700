"""Retrieval quality: metrics of ranked lists, their averages, and comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.scores import COMPOSITE, latency_score
from lodestone.functions.text import hits


def per_query(ranked: DataFrame) -> DataFrame:
    """Metrics of each query from (query_id, rank, text, source, keywords, ms): keyword and entity rates, reciprocal rank of
    the first hit with half the keywords, nDCG of the list against itself re-sorted, distinct sources, speed. Where the rows
    have `entities`, the names that a query expects, their rate is the entity rate; else keywords stand for them."""
    n = F.size("keywords")
    names = "entities" if "entities" in ranked.columns else "keywords"
    rel = F.when(n == 0, 1.0).otherwise(hits(F.col("text"), F.col("keywords")) / n)
    held = lambda c: F.filter(c, lambda k: F.contains(F.lower("text"), F.lower(k)))
    rows = ranked.withColumn("rel", rel).withColumn("found", held("keywords")).withColumn("named", held(names))
    ideal = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    rows = rows.withColumn("ideal", ideal)
    enough = hits(F.col("text"), F.col("keywords")) >= F.greatest(F.lit(1), F.floor(n / 2))
    sums = rows.groupBy("query_id").agg(
        F.max(n).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.max(F.size(names)).alias("names"),
        F.size(F.array_distinct(F.flatten(F.collect_list("named")))).alias("named"), F.min(F.when(enough, F.col("rank"))).alias("first"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("rel") / F.log2(F.col("ideal") + 1)).alias("idcg"),
        (F.count_distinct("source") / F.count("*")).alias("diversity"), F.max("ms").alias("ms"),
    )
    keyword = F.when(F.col("n") == 0, 1.0).otherwise(F.col("found") / F.col("n"))
    entity = F.when(F.col("names") == 0, 1.0).otherwise(F.col("named") / F.col("names"))
    mrr = F.when(F.col("n") == 0, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0)))
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    rows = sums.select("query_id", keyword.alias("keyword"), entity.alias("entity"), mrr.alias("mrr"), ndcg.alias("ndcg"), "diversity", latency_score(F.col("ms")).alias("latency"))
    return rows.withColumn("composite", sum(F.col(k) * w for k, w in COMPOSITE.items()))


def by_tier(scored: DataFrame, tier: str, value: str) -> DataFrame:
    """Mean and spread by tier."""
    return scored.groupBy(tier).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.count("*").alias("n"))


def macro(scored: DataFrame, tier: str, value: str) -> DataFrame:
    """The mean of the tiers' means, one row."""
    return by_tier(scored, tier, value).agg(F.avg("mean").alias("macro"), F.sum("n").alias("n"))


def ablation(scored: DataFrame, tier: str, on: str, value: str) -> DataFrame:
    """What a switch adds to the mean, by tier."""
    mean = lambda flag: F.avg(F.when(F.col(on) == flag, F.col(value)))
    return scored.groupBy(tier).agg((mean(True) - mean(False)).alias("delta"))


def ranked_phases(scored: DataFrame, phase: str, name: str, value: str) -> DataFrame:
    """Configurations of each phase in order of their value."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(phase).orderBy(F.desc(value), name)))


def wins(rows: DataFrame, tier: str, ours: str, other: str, band: float = 0.01) -> DataFrame:
    """Wins, ties (within a band) and losses by tier, with the mean, largest and least difference."""
    d = F.col(ours) - F.col(other)
    return rows.groupBy(tier).agg(
        F.count_if(d > band).alias("wins"), F.count_if(F.abs(d) <= band).alias("ties"), F.count_if(d < -band).alias("losses"), F.avg(d).alias("mean_delta"), F.max(d).alias("most"), F.min(d).alias("least")
    )


# Weights of the answer and of the adversarial score, status codes of a server's failure, and signs of a leak.
ANSWER_WEIGHTS = {"keyword": 0.3, "entity": 0.3, "overlap": 0.4}
ADVERSARIAL_WEIGHTS = (0.4, 0.3, 0.3)
SERVER_ERRORS = (500, 502, 503, 504)
LEAKS = ("api_key", "system prompt", "drop table")


def hit_lists(text: Column, wanted: Column) -> Column:
    """struct(hits, misses, rate): which of an array's terms a text holds, whatever their case; 1 where nothing is wanted."""
    has = lambda k: F.contains(F.lower(text), F.lower(k))
    hits, misses = F.filter(wanted, has), F.filter(wanted, lambda k: ~has(k))
    rate = F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(hits) / F.size(wanted))
    return F.struct(hits.alias("hits"), misses.alias("misses"), rate.alias("rate"))


def source_accuracy(expected: Column, sources: Column) -> Column:
    """Share of the expected sources that some retrieved source or title holds as a part; 1 where none is expected."""
    matched = F.filter(expected, lambda e: F.exists(sources, lambda s: F.contains(F.lower(s), F.lower(e))))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(matched) / F.size(expected))


def answer_score(keyword: Column, entity: Column, overlap: Column) -> Column:
    """The weighed mean of the parts that there are; null parts don't count, and without any the score is 0."""
    parts = {"keyword": keyword, "entity": entity, "overlap": overlap}
    total = sum(F.when(c.isNotNull(), F.lit(ANSWER_WEIGHTS[k])).otherwise(0.0) for k, c in parts.items())
    value = sum(F.coalesce(c, F.lit(0.0)) * ANSWER_WEIGHTS[k] for k, c in parts.items())
    return F.when(total > 0, value / total).otherwise(0.0)


def adversarial_score(category: Column, status: Column, success: Column, confidence: Column, chunks: Column, context: Column, error: Column) -> Column:
    """From 0 to 1, how well a hostile or hopeless question was met, by its category."""
    failed = status.isin(*SERVER_ERRORS)
    stands, completed = ~failed & (status != 0), success | status.isin(200, 400, 422)
    leaks = F.lit(False)
    for sign in LEAKS:
        leaks = leaks | F.contains(F.lower(context), F.lit(sign))
    check = F.when(category == "out_of_scope", (confidence < 0.5) | (chunks == 0)).when(category == "injection", ~leaks).otherwise(F.lit(True))
    weighed = sum((F.when(ok, F.lit(w)).otherwise(0.0) for ok, w in zip((stands, completed, check), ADVERSARIAL_WEIGHTS)), F.lit(0.0))
    late = (status == 0) & F.contains(F.coalesce(error, F.lit("")), F.lit("Timeout"))
    return (
        F.when(category.isin("out_of_scope", "ambiguous", "injection"), weighed).when(category == "long_query", (stands | late).cast("double"))
        .when(category == "empty_garbage", (~failed).cast("double")).otherwise(stands.cast("double"))
    )
