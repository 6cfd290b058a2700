"""N-gram join and decontamination against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import brute_components, brute_hits

from lodestone.llm import decontamination, ngram_join
from lodestone.llm.components import components


def near_copies(seed, groups):
    """Groups of near copies of one text (some far from each other, near to the original), passages shared by all."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for size, length, edits in groups:
        base = [word() for _ in range(length)]
        for k in range(size):
            w = base[:]
            for _ in range(edits if k else 0):
                w[r.randrange(length)] = word()
            rows.append(" ".join(w))
    rows += [" ".join([*passage, *(word() for _ in range(k % 9))]) for k in range(45)]
    rows += [" ".join([*passage[k % 20 :], *(word() for _ in range(40))]) for k in range(20)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed, [(40, 120, 3), (25, 60, 2), (30, 40, 3), (3, 200, 5), (2, 7, 1), (20, 90, 6), (60, 80, 4), (30, 70, 9)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("hot,bits", [(0, None), (16, None), (1 << 20, 24), (0, 24)])
def test_components_however_few_shingles_the_order_lists(spark, monkeypatch, hot, bits):
    rows = near_copies(3, [(40, 120, 3), (25, 60, 2), (30, 40, 3), (20, 90, 6), (60, 80, 4), (30, 70, 9)])
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "LOT", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _, labels = ngram_join.links(df, bits=bits)
    nodes = ngram_join.nodes(df, "doc_id", "text")
    full = nodes.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    least = full.groupBy("label").agg(F.min("doc_id").alias("least"))
    assert sorted(map(tuple, full.join(least, "label").select("doc_id", "n_shingles", "least").collect()), key=str) == brute_components(rows)


def test_passages_of_many_leave_few_pairs_over_though_the_order_is_small(spark, monkeypatch):
    r = random.Random(11)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for _ in range(15):
        passage = words(60)
        rows += [" ".join([*passage, *words(90)]) for _ in range(45)]
    rows = list(enumerate(rows))
    left, was = [], ngram_join._left_over
    monkeypatch.setattr(ngram_join, "HOT", 512)
    monkeypatch.setattr(ngram_join, "_left_over", lambda *a: left.append(was(*a)) or left[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str) == brute_components(rows)
    n = left[0].count()
    assert n < len(rows), n


def test_components_of_awkward_rows(awkward, awkward_texts):
    assert sorted(map(tuple, ngram_join.jaccard_components(awkward).collect()), key=str) == brute_components(awkward_texts)


def test_one_of_each_keeps_columns(awkward, awkward_texts):
    got = ngram_join.one_of_each(awkward)
    assert got.schema == awkward.schema
    want = {(i, t) for i, t in awkward_texts if (t or "").strip()}
    firsts = {c for _, _, c in brute_components(awkward_texts)}
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [x for x in kept if (x[1] or "").strip()] == sorted((x for x in set(want) if x[0] in firsts), key=str)
    assert sum(not (t or "").strip() for _, t in kept) == 3


def test_trie_prunes_to_the_exact_links():
    import numpy as np

    r = np.random.default_rng(3)
    probe = np.sort(r.choice(1000, 40, replace=False)).astype(np.uint64)
    sets = []
    for k in range(60):
        keep = r.choice(probe, 40 - k % 12, replace=False)
        sets.append(np.sort(np.unique(np.concatenate([keep, r.integers(1000, 2000, k % 7).astype(np.uint64)]))))
    want = []
    for s in sets:
        both = len(np.intersect1d(s, probe))
        want.append(100 * both >= 75 * (len(s) + len(probe) - both))
    assert [x >= 0 for x in ngram_join.trie_overlaps(probe, sets)] == want and any(want) and not all(want)
    assert ngram_join.trie_overlaps(probe, sets, [True] * 60) == [len(np.intersect1d(s, probe)) for s in sets]


def test_components_operator(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (2, 2)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_join_of_nothing(nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0
    assert ngram_join.one_of_each(nothing).count() == 0


@pytest.fixture(scope="module")
def contaminated(awkward_texts):
    r = random.Random(5)
    long = [f"w{r.randrange(50)}" for _ in range(60)]
    items = [(1, " ".join(long)), (2, "Short One"), (3, None), (4, ""), (5, " ".join(long[10:35])), (6, "Été naïve"), (None, "x y z"), (7, " ".join(long)), (8, "a"), (9, awkward_texts[5][1])]
    docs = [*awkward_texts, (20, "Some words, " + " ".join(long[5:25]) + " end"), (21, "a short ONE here " * 3), (22, " ".join(long[:12])), (23, "pre " + " ".join(long[20:33]) + " x" * 400), (24, "ÉTÉ NAÏVE été naïve"), (25, "w1 " * 40 + " ".join(long[30:50]))]
    return docs, items


def test_contamination(spark, contaminated):
    docs, items = contaminated
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    assert sorted(map(tuple, decontamination.contamination(d, b).collect()), key=str) == want
    # beyond the size that is broadcast, fingerprints are joined by shuffle
    assert sorted(map(tuple, decontamination.contamination(d, b, broadcast_bytes=0).collect()), key=str) == want
    clean = sorted(((i, t) for i, t in docs if (i, t) not in {(i, t) for (i, t) in docs if any(w[0] == i and w[5] for w in want)}), key=str)
    for most in (1 << 20, 0):
        assert sorted(((r.doc_id, r.text) for r in decontamination.decontaminated(d, b, broadcast_bytes=most).collect()), key=str) == clean


def test_contamination_by_nothing(spark, awkward, awkward_texts, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    for most in (1 << 20, -1):
        got = decontamination.contamination(awkward, none, broadcast_bytes=most).collect()
        assert len(got) == len(awkward_texts) and not any(r.contaminated or r.n_hit for r in got)
    assert decontamination.contamination(nothing, none).count() == 0
