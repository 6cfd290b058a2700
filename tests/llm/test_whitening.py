"""Whitening against plain Python with whole numbers and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, kind string, component string, whitened string"


def rows(values):
    return [(i, v, 1, "a", "b", "c", "d", "e") for i, v in values]


def brute(values):
    """vec_id, x for vectors that take part; the covariance of the distinct x as fractions; sums and n."""
    fine = [(i, v) for i, v in values if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in fine]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    cov = [[sum((v[i] - Fraction(sums[i], n)) * (v[j] - Fraction(sums[j], n)) for v in fit) / n for j in range(d)] for i in range(d)]
    return x, fit, sums, cov


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    base = [(k, [r.gauss(0, 1) * (j + 1) for j in range(20)]) for k in range(150)]
    odd = [(1000, None), (1001, []), (1002, [None] + [0.0] * 19), (1003, [float("nan")] * 20), (1004, [float("inf")] + [0.0] * 19), (1005, [1.0, 2.0])]
    return base + [(900 + k, base[7][1]) for k in range(60)] + [(None, base[3][1]), (2, base[2][1])] + odd


def test_equal_to_fractions_and_numpy(spark, values):
    got = whitening.whitened(spark.createDataFrame(rows(values), SCHEMA).repartition(5)).collect()
    x, fit, sums, cov = brute([v for v in values if v[0] != 1005])
    n, v = len(fit), np.array([[float(c) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    assert len(got) == 16 * len(x)
    w = {tuple(f): [float(sum((Fraction(c) - Fraction(s, n)) * Fraction(float(a)) for c, s, a in zip(f, sums, u[:, k]))) / math.sqrt(e[k]) for k in range(16)] for f in fit}
    want = {}
    for i, f in x:
        want.setdefault(i, (sum((n * c - s) ** 2 for c, s in zip(f, sums)), w[tuple(f)]))
    sign = {}
    for r in got:
        assert r.n == n and r.deviation == want[r.vec_id][0]
        value = want[r.vec_id][1][r.component - 1]
        if abs(value) > 0.1:
            assert sign.setdefault(r.component, np.sign(value) == np.sign(r.whitened)) == (np.sign(value) == np.sign(r.whitened))
        assert abs(abs(value) - abs(r.whitened)) < 1e-8
        assert abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9 and r.identity_error < 1e-8
    assert len({r.identity_error for r in got}) == 1 and len(sign) == 16


def test_polarisation_is_exact_for_large_numbers():
    r = random.Random(1)
    y = np.array([[r.randrange(-(1 << 58), 1 << 58) for _ in range(4)] for _ in range(9)])
    got = whitening.square_sums(y).tolist()
    v = y.tolist()
    want = [sum(a[i] ** 2 for a in v) for i in range(4)] + [sum((a[i] + a[j]) ** 2 for a in v) for i in range(4) for j in range(i + 1, 4)]
    assert got == want
    rest = [sum(a[i] for a in v) for i in range(4)]
    cov = whitening.covariance(9, rest, got)
    for i in range(4):
        for j in range(4):
            assert cov[i, j] == float(Fraction(9 * sum(a[i] * a[j] for a in v) - rest[i] * rest[j], 81))


def test_limbs_add_up():
    sums = [0, 5, -7, 1 << 170, -(1 << 150) + 3]
    batch = whitening._limbs(list(range(5)), sums)
    back = [sum(batch.column(k + 1)[i].as_py() << (whitening.LIMB * k) for k in range(whitening.LIMBS)) for i in range(5)]
    assert back == sums


def test_deviation_beyond_64_bits_is_null(spark):
    got = whitening.whitened(spark.createDataFrame(rows([(1, [1e14, 0.0]), (2, [0.0, 0.0])]), SCHEMA.replace("array<float>", "array<double>"))).collect()
    assert {r.deviation for r in got} == {None} and len(got) == 2


@pytest.mark.parametrize("values", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, values):
    assert whitening.whitened(spark.createDataFrame(rows(values), SCHEMA)).collect() == []


def test_rank_bounds_components(spark):
    got = whitening.whitened(spark.createDataFrame(rows([(1, [0.0, 0.0, 5.0]), (2, [1.0, 1.0, 5.0]), (3, [2.0, 2.0, 5.0])]), SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in got) == [(1, 1, round(1.5**0.5, 9)), (2, 1, 0.0), (3, 1, round(1.5**0.5, 9))]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)
