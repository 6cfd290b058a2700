"""Language model, language identification, nearest neighbours."""

import itertools
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, language_id, lm_scoring
from lodestone.llm.bytesio import slices

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_base(rows):
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\0"] for _, t in rows]
    c = Counter(w for k, t in enumerate(tokens) if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held[k], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for k, ((i, _), t) in enumerate(zip(rows, tokens))), key=str)


def test_unigrams_equal_brute_force(awkward, awkward_texts, nothing):
    got = lm_scoring.score(awkward, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base(awkward_texts)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score(nothing, F.lit(False)).count() == 0
    every = lm_scoring.score(awkward, F.lit(True)).collect()  # nothing to learn from
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in every)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    counts = r.integers(1, 50, len(keys))
    size, kinds = (np.bincount(lm_scoring.usual_leaf(keys), weights=w, minlength=lm_scoring.WIDE**2).astype(np.int64) for w in (counts, counts > 0))
    for n_own in (lm_scoring.OWN, 40, 1):
        own = np.append(keys[: n_own - 1], lm_scoring.END)
        model = lm_scoring.Model(own, np.append(counts[: n_own - 1], 0), size, kinds)
        for w in model.weights:
            w[:] = r.normal(size=w.shape)
        every, n = np.append(keys, lm_scoring.END), np.append(counts, 0)
        history = np.array([[5], [7], [9]], np.uint64)
        leaf = model.leaf(every)
        known = model.log_leaves(np.repeat(history, len(every), 1), leaf) + model.log_tokens(leaf, n)
        rest = np.arange(lm_scoring.OWN, lm_scoring.WIDE**2)  # one unknown token a leaf
        unknown = model.log_leaves(np.repeat(history, len(rest), 1), rest) + model.log_tokens(rest, np.zeros(len(rest)))
        assert np.exp(known).sum() + np.exp(unknown).sum() == pytest.approx(1.0, abs=1e-5)


def brute_model(rows, held):
    """The model of plain dictionaries, all weights 0: what the rounds and the scores need, token by token."""
    wide = lm_scoring.WIDE
    texts = [lm_scoring.Tokens(next(slices(pa.array([t or ""], pa.string())))) for _, t in rows]
    keys = [[int(k) for k in t.key] for t in texts]
    histories = [[tuple(int(x) for x in h) for h in t.history().T] for t in texts]
    count = Counter(k for k_, h in zip(keys, held) if not h for k in k_)
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    own = sorted(count, key=lambda k: (-count[k], signed(k)))[: lm_scoring.OWN]
    if int(lm_scoring.END) not in own:
        own = [*own[: lm_scoring.OWN - 1], int(lm_scoring.END)]
    usual = {k: int(lm_scoring.usual_leaf(np.array([k], np.uint64))[0]) for k_ in keys for k in k_}
    leaf = {k: own.index(k) if k in own else usual[k] for k in usual}
    size, kinds = Counter(), Counter()
    for k, n in count.items():
        if k not in own:
            size[leaf[k]] += n
            kinds[leaf[k]] += 1
    mass = {x: size[x] + 0.5 for x in range(lm_scoring.OWN, wide * wide)} | {i: count[k] + 0.5 for i, k in enumerate(own)}
    whole = [sum(mass.get(c * wide + x, 0) for x in range(wide)) for c in range(wide)]
    weights = [Counter(), Counter()]

    def places(level, history, c):
        inner = lm_scoring.mix(np.array([(h * wide + c) % (1 << 64) for h in history], np.uint64)).tolist()
        return [(k, h % lm_scoring.HASHED[level]) for k, h in enumerate(inner if level else history)]

    def chances(level, history, c):
        at = places(level, history, c)
        bias = [mass.get(c * wide + x, 0) / whole[c] if level else whole[x] / sum(whole) for x in range(wide)]
        x = [b * math.exp(sum(weights[level][p, i] for p in at)) for i, b in enumerate(bias)]
        return at, [v / sum(x) for v in x]

    return keys, histories, count, leaf, size, kinds, weights, chances


def test_scores_equal_brute_force_however_rows_are_dealt(spark):
    r = random.Random(5)
    vocabulary = [f"{a}{i}{e}" for i in range(150) for a, e in (("k", "ou"), ("m", "ung"), ("x", "é"), ("b", "a"))]
    rows = [(i, " ".join(r.choice(vocabulary[: 20 + 29 * (i % 21)]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of_round = {x.doc_id: x.r for x in df.select("doc_id", F.expr(f"pmod(xxhash64(doc_id, text), {lm_scoring.ROUNDS})").alias("r")).collect()}
    held = [i % 4 == 1 for i, _ in rows]
    keys, histories, count, leaf, size, kinds, weights, chances = brute_model(rows, held)
    for number in range(lm_scoring.ROUNDS):
        met, expected = [Counter(), Counter()], [Counter(), Counter()]
        for (i, _), h, ks, hs in zip(rows, held, keys, histories):
            if not h and of_round[i] == number:
                for k, history in zip(ks, hs):
                    c, x = divmod(leaf[k], lm_scoring.WIDE)
                    for level, goal in ((0, c), (1, x)):
                        at, p = chances(level, history, c)
                        for place in at:
                            met[level][place, goal] += 1
                            for j, v in enumerate(p):
                                expected[level][place, j] += v
        for level in (0, 1):
            n = Counter()
            for (place, _), v in met[level].items():
                n[place] += v
            for (place, j), e in expected[level].items():
                if e > 1e-12 * n[place]:
                    drawn = lm_scoring.PRIOR * e / n[place]
                    weights[level][place, j] += (lm_scoring.RATE if number else lm_scoring.FIRST) * math.log((met[level][place, j] + drawn) / (e + drawn))
    want = {}
    for (i, _), ks, hs in zip(rows, keys, histories):
        want[i] = 0.0
        for k, history in zip(ks, hs):
            c, x = divmod(leaf[k], lm_scoring.WIDE)
            share = 1.0 if leaf[k] < lm_scoring.OWN else (count[k] + 0.5) / (size[leaf[k]] + 0.5 * (kinds[leaf[k]] + 1))
            want[i] += math.log10(chances(0, history, c)[1][c]) + math.log10(chances(1, history, c)[1][x]) + math.log10(share)
    for parts in (1, 8):
        got = {x.doc_id: x.score for x in lm_scoring.score(df.repartition(parts), F.col("doc_id") % 4 == 1).collect()}
        assert got == {i: pytest.approx(v, rel=1e-5) for i, v in want.items()}


def test_model_beats_unigrams_on_text_held_out(spark):
    r = random.Random(3)
    nouns = [[f"{a}{i}{e}" for i in range(40)] for a, e in (("k", "ou"), ("m", "ung"))]
    rows = [(i, " ".join(r.choice(nouns[i % 2]) for _ in range(80))) for i in range(300)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1).where("held_out").collect()
    assert len(got) > 20 and sum(x.score for x in got) > sum(x.base_score for x in got) + 0.05 * sum(x.n_tokens for x in got)


@pytest.mark.parametrize("lengths", [[1], [3, 5], [100, 1, 49, 48, 2]])
def test_forward_backward(lengths):
    r = np.random.default_rng(len(lengths))
    k, n = 3, sum(lengths)
    scores, change = r.normal(size=(n, k)) * 2, r.normal(size=(k, k))
    got, joint, norm = language_id.forward_backward(scores, np.array(lengths), change, pairs=True)
    at, total, moves = 0, 0.0, np.zeros((k, k))
    for m in lengths:
        s = scores[at : at + m]
        if m <= 5:
            ways = list(itertools.product(range(k), repeat=m))
            start = np.log(np.exp(change).sum(0) / k)
            w = np.array([start[p[0]] + sum(s[i, p[i]] for i in range(m)) + sum(change[p[i - 1], p[i]] for i in range(1, m)) for p in ways])
            total += np.logaddexp.reduce(w)
            w = np.exp(w - np.logaddexp.reduce(w))
            for i in range(m):
                for j in range(k):
                    assert got[at + i, j] == pytest.approx(sum(x for x, p in zip(w, ways) if p[i] == j), abs=1e-9)
            for x, p in zip(w, ways):
                for i in range(1, m):
                    moves[p[i - 1], p[i]] += x
        at += m
    if max(lengths) <= 5:
        assert norm == pytest.approx(total) and np.allclose(joint, moves)
    assert np.allclose(got.sum(1), 1)


def test_languages(spark, data, awkward, awkward_texts, nothing):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = language_id.identify(docs, learn).join(docs.where(~learn).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    for r in language_id.identify(awkward, F.lit(True)).collect():
        text = dict((i, t) for i, t in awkward_texts)[r.doc_id] or ""
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text)))
    assert all(r.lang_pred == "und" for r in language_id.identify(awkward, F.lit(False)).collect())
    assert language_id.identify(nothing, F.lit(True)).count() == 0
    kept = language_id.identified(awkward, F.lit(True), 0.5)
    assert kept.schema == awkward.schema and kept.count() == sum(any(map(str.isalpha, t or "")) for _, t in awkward_texts)


def test_a_language_of_long_texts_alone_is_learned(spark):
    r = random.Random(4)
    text = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(i, text("abcde", 50), "one") for i in range(40)] + [(100 + i, text("vwxyz", 40_000), "two") for i in range(2)] + [(200 + i, text("vwxyz", 50), None) for i in range(5)]
    got = {x.doc_id: x.lang_pred for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert got == {i: "one" if i < 100 else "two" for i, _, _ in rows}


def test_words_of_mixed_text_are_labelled_apart():
    en = ["the house and the river with stones"] * 40
    fr = ["maison près rivière avec pierres grandes"] * 40
    field = language_id.fit([*en, *fr], ["en"] * 40 + ["fr"] * 40)
    for part in slices(pa.array([" ".join([*en[:3], *fr[:3]])])):
        from lodestone.llm.bytesio import Words, spaced

        w = Words(part, spaced())
        m = language_id.forward_backward(field.emissions(w.lower, w.starts, w.ends, w.hash), w.counts, field.change)
    assert m.argmax(1).tolist() == [0] * 21 + [1] * 18


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, size=(1500, 1))
    x[700:760] = x[20]  # many equal vectors
    rows = [(i, x[i].tolist()) for i in range(1500)] + [(5, x[5].tolist()), (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None, *[1.0] * 15]), (None, [1.0] * 16), (2020, [1.0, 2.0]), (2021, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard=500).collect()
    by = {}
    for row in got:
        by.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert set(by) == {i for i in range(1500) if i % 20 == 0} | {2020}
    assert [v for _, v, _ in by[2020]] == [2021]
    found = right = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:20]
        own = sorted(by[q])
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(v != q for _, v, _ in own)
        assert all(v == pytest.approx(s[i]) for _, i, v in own) and own == sorted(own, key=lambda t: (-t[2], t[1]))
        found += 20
        right += len({i for _, i, _ in own} & set(want))
    assert right / found >= 0.9
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_equal_vectors_go_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [0.5, 0.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 40, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
