"""Substring deduplication against plain Python over all windows, and against SQL."""

import random

import duckdb
import numpy as np
import pytest

from lodestone.llm import oracles, suffix_dedup
from lodestone.llm.queries import op12_substring_dedup
from tests_llm_helpers import brute_repeats

FIELDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def found(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    word = lambda: r.choice("abcdefghijkl") + r.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (13, 14, 40, 60, 12)]
    out = []
    for i in range(120):
        text = [word() for _ in range(r.randint(0, 30))]
        for p in r.sample(passages, r.randint(0, 3)):
            p = list(p)
            if r.random() < 0.4:
                p[r.randrange(len(p))] = word()
            text += p + [word() for _ in range(r.randint(0, 3))]
        out.append((r.randrange(200), r.choice([" ", "\n", " \t "]).join(text)))
    return out + [out[3], out[3], (500, out[4][1]), (None, out[4][1]), (-5, out[9][1]), (501, "A B C d e f g h i j k l m n"), (502, "a B C d e f g h i j k l m n")]


def test_equal_to_all_windows(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = found(suffix_dedup.digests(docs))
    assert got == brute_repeats(rows)
    assert sum(r[2] for r in got) > 1000


def test_hot_anchors_are_cut_into_windows(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(suffix_dedup.digests(docs)) == brute_repeats(rows)


def test_awkward_texts(awkward, awkward_texts):
    assert found(suffix_dedup.digests(awkward)) == brute_repeats(awkward_texts)


def test_empty(nothing):
    assert found(suffix_dedup.digests(nothing)) == []


def test_ids_of_another_type(spark, rows):
    own = [(None if i is None else f"d{i}", t) for i, t in rows]
    assert found(suffix_dedup.digests(spark.createDataFrame(own, "doc_id string, text string"))) == brute_repeats(own)


def test_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({oracles.SUBSTRING_DEDUP})").fetchall()
    assert found(op12_substring_dedup(spark, data)) == sorted(want, key=str)


def test_automaton_against_all_substrings():
    r = random.Random(5)
    for _ in range(200):
        a, seen = suffix_dedup.Automaton(), {}
        for label in range(r.randint(1, 6)):
            words = [r.choice("abc") for _ in range(r.randint(1, 12))]
            size = 3
            known = a.windows(words, size)
            assert known == [seen.get(tuple(words[i : i + size])) for i in range(len(words) - size + 1)]
            a.add(words, label)
            for i in range(len(words) - size + 1):
                seen.setdefault(tuple(words[i : i + size]), label)
            asked = [r.choice("abcd") for _ in range(20)]
            assert a.windows(asked, size) == [seen.get(tuple(asked[i : i + size])) for i in range(18)]


def test_covered():
    got = suffix_dedup.covered(30, np.array([2, 10]), np.array([0b101, 0b1]))
    assert np.flatnonzero(got).tolist() == list(range(2, 23))
