"""Column expressions on scores: normalisation, buckets, fusion weights, composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knots of the score scales, and weights.
SEARCH_SCALE = ((0.45, 0.90, 0.4), (0.35, 0.80, 1.0), (0.25, 0.65, 1.5), (0.15, 0.40, 2.5), (0.10, 0.25, 3.0))
HOP_SCORES = {0: 1.0, 1: 0.7, 2: 0.4}
COMPOSITE = {"keyword": 0.35, "entity": 0.15, "mrr": 0.20, "ndcg": 0.15, "diversity": 0.10, "latency": 0.05}
SLOWEST_MS = 2000.0


def normalized(score: Column) -> Column:
    """A raw similarity on a scale from 0 to 0.98."""
    out = None
    for knot, base, slope in SEARCH_SCALE:
        value = F.lit(base) + (score - knot) * slope
        value = F.least(F.lit(0.98), value) if out is None else value
        out = F.when(score >= knot, value) if out is None else out.when(score >= knot, value)
    return out.otherwise(score * 2.5)


def confidence(best: Column, least: float = 0.20, high: float = 0.4) -> Column:
    return F.when(best < least, "low").when(best < high, "medium").otherwise("high")


def corrective_confidence(best: Column) -> Column:
    return F.when(best >= 0.35, "high").when(best >= 0.25, "medium").otherwise("low")


def hop_score(hops: Column, match: Column) -> Column:
    out = F.lit(0.2)
    for n, score in HOP_SCORES.items():
        out = F.when(hops == n, score).otherwise(out)
    return out * F.least(match, F.lit(1.0))


def latency_score(ms: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ms / SLOWEST_MS))


def composite(**parts: Column) -> Column:
    return sum(parts[name] * weight for name, weight in COMPOSITE.items())
