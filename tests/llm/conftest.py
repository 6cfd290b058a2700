import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, node string, part string, row string, label string, id string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def awkward_texts():
    """(id, text): nulls, empty and very long texts, copies, other scripts, special strings, marks."""
    passage = words(40, 1)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (None, "no id here at all, none"), (None, "no id here at all, none"), (4, passage), (5, passage), (5, passage),
        (6, passage + " and a tail"), (7, words(3, 2)), (8, words(30000, 3)), (9, "a" * 5000), (10, "ÀÉÎ ñ ß Œuvre été İstanbul 日本語 ½ x² naïve"),
        (11, "don't <|endoftext|> WE'LL <|ENDOFTEXT|> x<|startoftext|>y 3,4.5-6 (a)_b"), (12, "... !!! ??? 123"), (13, "x y q\u0085r \x00z  end"), (14, words(12, 4)), (15, words(13, 5)),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_texts):
    """The same with the columns of documents and others whose names clash."""
    rows = [(i, t, "en" if k % 2 else None, "s", 1, "a", "b", "c", "d", "e", "f", "g") for k, (i, t) in enumerate(awkward_texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
