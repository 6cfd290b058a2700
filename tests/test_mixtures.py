"""Mixtures of groups against numpy on one group after another."""

import numpy as np

from lodestone.operators import mixtures


def em(x, begin, rounds):
    """The same by plain numpy from the given first means: log-likelihoods and responsibilities."""
    k = len(begin)
    w, mean, var = np.full(k, 1 / k), np.array(begin), np.tile(x.var(0) + mixtures.VARIANCE, (k, 1))
    history = []

    def responsibilities():
        log = np.log(np.maximum(w, 1e-300)) - 0.5 * (((x[:, None] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        return p / p.sum(1, keepdims=True), float((top[:, 0] + np.log(p.sum(1))).sum())

    for _ in range(rounds):
        p, likelihood = responsibilities()
        history.append(likelihood)
        n = p.sum(0)
        w, mean = n / n.sum(), p.T @ x / n[:, None]
        var = np.maximum(p.T @ x**2 / n[:, None] - mean**2, 0) + mixtures.VARIANCE
    return history, responsibilities()[0]


def test_equal_to_numpy_in_any_lots(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 4)) * 6
    x = np.concatenate([c + r.normal(size=(25, 4)) for c in centres])
    rows = [("a", i, x[i].tolist()) for i in range(120)] + [("b", 500 + i, x[i + 90].tolist()) for i in range(60)] + [("c", 900, [1.0, 2.0, 3.0, 4.0]), (None, 1, [0.0] * 4), ("a", 9999, None)]
    frame = spark.createDataFrame(rows, "group string, id long, v array<double>").repartition(5)
    for lot in (5000, 13):
        monkeypatch.setattr(mixtures, "LOT", lot)
        monkeypatch.setattr(mixtures, "TOGETHER", 3)
        model, dealt = mixtures.fitted(frame, rounds=6)
        order = {(d.group, d.id): d.order for d in dealt.collect()}
        found = {(c.group, c.id): c for c in mixtures.clustered(frame, rounds=6).collect()}
        assert len(found) == 181
        for m in model.collect():
            own = sorted((order[g, i], i, v) for g, i, v in rows if g == m.group and v is not None)
            values = np.array([v for _, _, v in own])
            assert m.k == mixtures.components(len(own)) and m.n == len(own)
            history, share = em(values, values[: m.k], len(m.history))
            assert np.allclose(m.history, history, rtol=1e-9) and all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:]))
            for (_, i, _), s in zip(own, share):
                c = found[m.group, i]
                assert abs(c.probability - s.max()) < 1e-6 and (s.max() < 0.51 or c.cluster == s.argmax())
                assert c.members == [j for j in range(m.k) if s[j] >= mixtures.SOFT] or min(abs(s - mixtures.SOFT)) < 1e-6


def test_components_follow_size():
    assert [mixtures.components(n) for n in (0, 1, 2, 3, 9, 10, 29, 100, 10_000)] == [1, 1, 1, 1, 1, 1, 2, 10, 64]


def test_groups_of_small_whole_numbers(spark):
    rows = spark.createDataFrame([(g, i, [float(i % 7), float(g)]) for g in (1, 2) for i in range(30)], "group int, id int, v array<float>")
    got = mixtures.clustered(rows, rounds=2)
    assert dict(got.dtypes)["group"] == "int" and got.count() == 60
    assert mixtures.clustered(rows.where("id < 0"), rounds=2).count() == 0
