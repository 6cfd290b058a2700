"""Gaussian mixtures of many groups at once, by expectation and maximisation.

Every group has as many components as its size asks for, with a variance for each dimension. Rows are dealt to lots of up to
LOT of their group. In a round each lot meets its group's model and returns sums (of responsibilities, of what they weigh,
of its squares, and the log-likelihood); lots are summed some at a time, then groups, whose models are the next round's.
So a round is the same few jobs whatever the number of groups, and no task holds a group. Sums go in order of lots,
so that they don't depend on how tasks are run.

Components begin at the rows of the least hashes, with the group's variances. A group's model keeps the log-likelihood of
each round; rounds end when no group gains TOLERANCE a row, or after ROUNDS. Null groups, ids and vectors take no part;
vectors of a group have one length. Groups of fewer than LEAST rows have one component. Jobs run when a function is called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import written

# Rows that a component is to have, at least and at most; what is added to variances; from which share of a
# row on it belongs to a component.
TARGET, LEAST, MOST_ROWS = 10, 3, 20
VARIANCE, SOFT = 1e-5, 0.1
#: The most components of a group, which bounds a model; more rows make them larger.
MOST = 64
ROUNDS, TOLERANCE, LOT, TOGETHER = 25, 1e-3, 5000, 64


def components(n: int) -> int:
    """How many components n rows ask for."""
    if n < LEAST:
        return 1
    return min(MOST, max(1, n // MOST_ROWS, min(max(1, n // TARGET), max(1, n // LEAST))))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Weights, means and variances of k components in d dimensions."""

    def __init__(self, k: int, flat: np.ndarray):
        d = (len(flat) // k - 1) // 2
        self.k, self.d = k, d
        self.weight, self.mean, self.variance = flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d :].reshape(k, d)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each row's responsibilities, and the rows' log-likelihood."""
        log = np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (np.log(2 * np.pi * self.variance).sum(1))
        # a component at a time: no array is larger than the rows
        log = np.stack([log[j] - 0.5 * ((x - self.mean[j]) ** 2 / self.variance[j]).sum(1) for j in range(self.k)], axis=1)
        top = log.max(1)
        own = np.exp(log - top[:, None])
        total = own.sum(1)
        return own / total[:, None], float((top + np.log(total)).sum())

    def sums(self, x: np.ndarray) -> np.ndarray:
        share, likelihood = self.shares(x)
        return np.concatenate([[likelihood], share.sum(0), (share.T @ x).ravel(), (share.T @ (x * x)).ravel()])

    def improved(self, sums: np.ndarray) -> np.ndarray:
        """The next model; a component that has lost all rows stays as it is, without weight."""
        k, d = self.k, self.d
        n = sums[1 : k + 1]
        held = np.maximum(n, 1e-12)[:, None]
        mean = sums[k + 1 : k + 1 + k * d].reshape(k, d) / held
        variance = np.maximum(sums[k + 1 + k * d :].reshape(k, d) / held - mean**2, 0) + VARIANCE
        some = (n > 1e-9)[:, None]
        return np.concatenate([n / max(n.sum(), 1e-300), np.where(some, mean, self.mean).ravel(), np.where(some, variance, self.variance).ravel()])


def _dealt(rows: DataFrame) -> DataFrame:
    """(group, lot, lots, n, id, order, v): order is the hash that components begin by."""
    rows = rows.select("group", "id", F.col("v").cast("array<double>").alias("v")).where("group is not null and id is not null and v is not null")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).withColumn("lots", F.ceil(F.col("n") / LOT))
    met = rows.join(sizes, "group").withColumn("order", F.xxhash64("id"))
    return written(met.select("group", F.pmod("order", "lots").alias("lot"), "lots", "n", "id", "order", "v"))


def _lots_of(model: DataFrame) -> DataFrame:
    return model.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))


def _summed(parts: DataFrame, kind: str) -> DataFrame:
    """(group, sums) of (group, lot, sums), TOGETHER lots at a time and then all."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("lot").to_numpy(), kind="stable")
        total = _matrix(table.column("sums"))[order].sum(0)
        return pa.table({"group": pa.array([key[0].as_py()], key[0].type), "lot": pa.array([int(table.column("lot").to_numpy().min())]), "sums": [total.tolist()]})

    some = parts.withColumn("some", F.floor(F.col("lot") / TOGETHER)).groupBy("group", "some").applyInArrow(add, f"group {kind}, lot long, sums array<double>")
    return some.groupBy("group").applyInArrow(add, f"group {kind}, lot long, sums array<double>").select("group", "sums")


def _begun(dealt: DataFrame, kind: str) -> DataFrame:
    """The first model of each group: (group, lots, n, k, model, history)."""

    def least(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A lot's rows of the least hashes, as many as its group has components, and its sums."""
        x, order = _matrix(table.column("v")), table.column("order").to_numpy()
        own = np.argsort(order, kind="stable")[: components(table.column("n")[0].as_py())]
        first = {"group": [key[0].as_py()] * len(own), "lot": [key[1].as_py()] * len(own), "order": order[own].tolist(), "v": x[own].tolist(), "sums": [None] * len(own)}
        sums = np.concatenate([x.sum(0), (x * x).sum(0)])
        first = {c: [*v, e] for (c, v), e in zip(first.items(), (key[0].as_py(), key[1].as_py(), None, None, sums.tolist()))}
        return pa.table(first, schema=pa.schema([("group", table.schema.field("group").type), ("lot", pa.int64()), ("order", pa.int64()), ("v", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))]))

    found = written(dealt.groupBy("group", "lot").applyInArrow(least, f"group {kind}, lot long, order long, v array<double>, sums array<double>"))
    sizes = dealt.groupBy("group").agg(F.max("n").alias("n"), F.max("lots").alias("lots"))
    sums = _summed(found.where("sums is not null").select("group", "lot", "sums"), kind)
    # of each group the MOST least: arrays of that many, merged
    best = found.where("v is not null").groupBy("group").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "v"))), 1, MOST).alias("first"))

    @F.udf("struct<k:int,model:array<double>>")
    def begin(n, first, sums):
        k, d = min(components(n), len(first)), len(sums) // 2
        mean, square = np.array(sums[:d]) / n, np.array(sums[d:]) / n
        variance = np.maximum(square - mean**2, 0) + VARIANCE
        return k, np.concatenate([np.full(k, 1 / k), np.array([f["v"] for f in first[:k]]).ravel(), np.tile(variance, k)]).tolist()

    rows = sizes.join(best, "group").join(sums, "group").withColumn("m", begin("n", "first", "sums"))
    return written(rows.select("group", "lots", "n", F.col("m.k").alias("k"), F.col("m.model").alias("model"), F.array().cast("array<double>").alias("history")))


def fitted(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """From rows (group, id, v): the models (group, lots, n, k, model, history), and the rows as they were dealt."""
    dealt = _dealt(rows)
    kind = dealt.schema["group"].dataType.simpleString()
    model = _begun(dealt, kind)

    def expect(key: tuple[pa.Scalar, ...], own: pa.Table, models: pa.Table) -> pa.Table:
        m = Model(models.column("k")[0].as_py(), np.array(models.column("model")[0].as_py()))
        return pa.table({"group": pa.array([key[0].as_py()], key[0].type), "lot": [key[1].as_py()], "sums": [m.sums(_matrix(own.column("v"))).tolist()]})

    @F.udf("array<double>")
    def improve(k, flat, sums):
        return Model(k, np.array(flat)).improved(np.array(sums)).tolist()

    for _ in range(rounds):
        parts = dealt.groupBy("group", "lot").cogroup(_lots_of(model).groupBy("group", "lot")).applyInArrow(expect, f"group {kind}, lot long, sums array<double>")
        met = model.join(_summed(parts, kind), "group")
        model = written(met.select("group", "lots", "n", "k", improve("k", "model", "sums").alias("model"), F.concat("history", F.array(F.col("sums")[0])).alias("history")))
        gain = F.element_at("history", -1) - F.element_at("history", -2)
        if not model.where((F.size("history") < 2) | (gain > TOLERANCE * F.col("n"))).limit(1).count():
            break
    return model, dealt


def clustered(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(group, id, cluster, probability, members): each row's likeliest component of its group, and all that have a share of SOFT or
    more in it."""
    model, dealt = fitted(rows, rounds)
    kind, id_kind = (dealt.schema[c].dataType.simpleString() for c in ("group", "id"))

    def assign(key: tuple[pa.Scalar, ...], own: pa.Table, models: pa.Table) -> pa.Table:
        m = Model(models.column("k")[0].as_py(), np.array(models.column("model")[0].as_py()))
        share, _ = m.shares(_matrix(own.column("v")))
        best = share.argmax(1)
        members = [np.flatnonzero(s >= SOFT).tolist() for s in share]
        return pa.table({"group": own.column("group"), "id": own.column("id"), "cluster": pa.array(best.astype(np.int32)), "probability": pa.array(share.max(1)), "members": pa.array(members, pa.list_(pa.int32()))})

    return dealt.groupBy("group", "lot").cogroup(_lots_of(model).groupBy("group", "lot")).applyInArrow(assign, f"group {kind}, id {id_kind}, cluster int, probability double, members array<int>")
