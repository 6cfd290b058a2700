"""Repeated rows of a language, settings left behind, and columns that clash."""

import pytest
from conftest import words
from pyspark.sql import functions as F

from lodestone.llm import decontamination, language_id, ngram_join, token_store

ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("doc_id", [1, 5, 77])
def test_a_language_of_repeated_rows_is_learned(spark, doc_id):
    same = [(doc_id, "zorp quux blarg zorp quux", "xx")] * 3000
    other = [(1000 + i, words(30, i), "yy") for i in range(50)]
    docs = spark.createDataFrame(same + other, "doc_id long, text string, lang string")
    got = language_id.identify(docs, F.lit(True)).groupBy("doc_id").agg(F.min("lang_pred").alias("x")).where(F.col("doc_id") == doc_id).first()
    assert got.x == "xx"


def test_reading_files_leaves_the_session_alone(spark, awkward, vocabulary, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_store.write(awkward, vocabulary, 1, path)
    before = spark.conf.get(ARROW)
    assert token_store.read(spark, path).count() == awkward.count()
    asked = spark.createDataFrame([(7, 0, 3)], "doc_id long, first long, count long")
    assert token_store.fetch(spark, path, asked).count() == 1
    assert spark.conf.get(ARROW) == before


def test_stages_take_columns_of_any_name(spark):
    rows = [(i, words(40, i // 2), "a", "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ROW_of_component string, contaminated_row string")
    assert ngram_join.one_of_each(docs).schema == docs.schema and ngram_join.one_of_each(docs).count() == 5
    items = spark.createDataFrame([(1, words(40, 3))], "item_id long, text string")
    kept = decontamination.decontaminated(docs, items, broadcast_bytes=0)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9]
