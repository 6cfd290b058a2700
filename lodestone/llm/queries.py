"""The queries of this folder, by the names that __spark_entry__.py registers, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lm_scoring import score

    return score(_table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe_codec import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), _vocabulary())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat_format import repair

    return repair(_table(spark, sf_dir, "conversations"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_store import stored_digests

    return stored_digests(_table(spark, sf_dir, "documents"), _vocabulary(), 1)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary(), 2048)


def remainder(column: str, of: int) -> Column:
    """crc32 of a number as text, modulo `of`."""
    return F.crc32(F.col(column).cast("string")) % of


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import identify

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    return identify(docs, ~held_out).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.turn_repair import damaged, digests, repair

    return digests(repair(damaged(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm import oracles

    return {"op2_ngram_join": oracles.NGRAM_JOIN, "op4_decontamination": oracles.DECONTAMINATION, "op12_substring_dedup": oracles.SUBSTRING_DEDUP, "op13_turn_repair": oracles.TURN_REPAIR}
