"""Vector upserts: chunks in order, in batches of a fixed number, cut again so that a model's attention fits a budget.

A topic's chunks are numbered without a task that sees the whole topic; UPSERT of them in a row are a batch. Inside, the
cost of n chunks is n times the square of the most tokens of one of them: a chunk that would lift the cost of the current
sub-batch above the budget starts the next one. That is a fold over up to UPSERT numbers, inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import numbered

# Chunks of an upsert, characters of a token, and the budget without a limit of memory.
UPSERT, CHARACTERS, BUDGET = 128, 4, 100_000_000


def tokens(text: Column) -> Column:
    """About how many tokens a text has; 1 at least, also for null."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / CHARACTERS)).cast("long")


def sub_batches(sizes: Column, budget: int = BUDGET) -> Column:
    """The number (from 0) of the sub-batch that each size of an array goes to."""

    def step(s: Column, t: Column) -> Column:
        most = F.greatest(s["most"], t)
        over = (s["n"] > 0) & ((s["n"] + 1) * most * most > budget)
        sub = s["sub"] + F.when(over, 1).otherwise(0)
        return F.struct(
            F.when(over, F.lit(1).cast("long")).otherwise(s["n"] + 1).alias("n"), F.when(over, t).otherwise(most).alias("most"), sub.cast("int").alias("sub"), F.concat(s["out"], F.array(sub.cast("int"))).alias("out")
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"), F.lit(0).alias("sub"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def batched(chunks: DataFrame, topic: str, order: str, text: str, kept: list[str], upsert: int = UPSERT, budget: int = BUDGET) -> DataFrame:
    """(topic, batch, sub_batch, position, tokens, order and kept columns) of each chunk. `order` tells a topic's chunks apart."""
    sizes = chunks.select(topic, order, *kept, tokens(F.col(text)).alias("tokens"))
    rows = numbered(sizes, [topic], [order]).withColumn("batch", F.floor((F.col("position") - 1) / upsert))
    own = F.array_sort(F.collect_list(F.struct("position", "tokens", order, *kept)))
    rows = rows.groupBy(topic, "batch").agg(own.alias("own"))
    flat = rows.select(topic, "batch", F.explode(F.arrays_zip(F.col("own"), sub_batches(F.col("own.tokens"), budget).alias("sub_batch"))).alias("x"))
    return flat.select(topic, "batch", F.col("x.sub_batch").alias("sub_batch"), "x.own.*")


def finite(vector: Column, dim: int) -> Column:
    """Whether a vector has the dimension and only finite numbers."""
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def outcome(batches: DataFrame, topic: str, ok: str) -> DataFrame:
    """(topic, batch, sub_batch, n, most, cost, ok, failed): what is upserted of each sub-batch; chunks without a fit vector
    fail alone."""
    rows = batches.groupBy(topic, "batch", "sub_batch").agg(F.count("*").alias("n"), F.max("tokens").alias("most"), F.count_if(ok).alias("ok"))
    return rows.select(topic, "batch", "sub_batch", "n", "most", (F.col("n") * F.col("most") * F.col("most")).alias("cost"), "ok", (F.col("n") - F.col("ok")).alias("failed"))
