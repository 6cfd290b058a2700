"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about SHARD rows by a hash of their id. A task builds its shard's graph: equal vectors are
one node; each node has a level by a hash; nodes come in batches, each searched in the graph so far and compared with
its own batch, and linked by the usual rule (a candidate is taken if it is nearer to the node than to those taken). The
graph is one row of a table: flat neighbour arrays for each level, the vectors and their ids. So that inner product
orders as distance does, graph vectors get one more component that makes all their norms equal.

Queries go to all shards in blocks, in which a beam of EF nodes is moved for many queries at once; scores are then
computed in double precision on the vectors as they came, and the shards' results merged. Blocks hold up to QUERIES, or
fewer where else some cores would have nothing to do; each copies a shard's row once. Every query searches every shard:
that is the method, and its work is the product of the two numbers.

Vectors that are null, zero, or hold a null or a component that isn't finite take no part, nor do rows without an id.
Vectors of different lengths never meet. Rows that repeat an id and vector are one; a query never finds its own id.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import mix
from lodestone.llm.tasks import written

SHARD = 16384
#: Most queries that a copy of a shard answers, and the fewest that are worth one.
QUERIES, FEWEST = 1 << 16, 256
M = 16
EF_BUILD, EF = 64, 160
BATCH = 512


def _sims(base: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of each row of q with the base rows of its ids; -inf where an id is negative."""
    out = np.matmul(base[ids], q[:, :, None])[:, :, 0]
    out[ids < 0] = -np.inf
    return out


class Graph:
    """base: vectors of equal norms; levels: for each level an array of neighbours by node, -1 where there is none."""

    def __init__(self, base: np.ndarray, levels: list[np.ndarray], entry: int):
        self.base, self.levels, self.entry = base, levels, entry

    def beam(self, level: int, q: np.ndarray, start: np.ndarray, ef: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """The `ef` best nodes found for each query, best first, and their inner products."""
        near = self.levels[level]
        b, ef = len(q), max(ef, start.shape[1])
        ids = np.full((b, ef), -1, np.int64)
        ids[:, : start.shape[1]] = start
        sims = _sims(self.base, ids, q)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        done = ids < 0
        seen = np.zeros((b, len(self.base) + 1), bool)
        seen[np.arange(b)[:, None], ids] = True
        live = np.arange(b)
        while len(live):
            open_ = ~done[live]
            rank = np.cumsum(open_, axis=1)
            some = rank[:, -1] > 0
            live, open_, rank = live[some], open_[some], rank[some]
            if not len(live):
                break
            pick = open_ & (rank <= wide)
            rows, cols = np.nonzero(pick)
            slot = rank[rows, cols] - 1
            chosen = np.full((len(live), wide), -1, np.int64)
            chosen[rows, slot] = ids[live[rows], cols]
            done[live[rows], cols] = True
            found = np.where(chosen[:, :, None] >= 0, near[chosen], -1).reshape(len(live), -1).astype(np.int64)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[live[:, None], found]] = -1
            seen[live[:, None], found] = True
            new = _sims(self.base, found, q[live])
            better = new > sims[live, -1][:, None]
            found[~better], new[~better] = -1, -np.inf
            new_done = found < 0
            all_ids = np.concatenate([ids[live], found], axis=1)
            all_sims = np.concatenate([sims[live], new], axis=1)
            all_done = np.concatenate([done[live], new_done], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            sims[live] = np.take_along_axis(all_sims, order, 1)
            done[live] = np.take_along_axis(all_done, order, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for level in range(len(self.levels) - 1, down_to, -1):
            start = self.beam(level, q, start[:, :8], 8)[0]
        return self.beam(down_to, q, start[:, :8], ef)


def choose(base: np.ndarray, node: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates, best first, up to `most` that are nearer to it than to one already taken; then the best
    others fill up half of what is left."""
    b, c = ids.shape
    taken = np.full((b, most), -1, np.int64)
    count = np.zeros(b, np.int64)
    chosen = np.zeros((b, c), bool)
    for k in range(c):
        on = np.flatnonzero((ids[:, k] >= 0) & (count < most))
        if not len(on):
            continue
        rival = _sims(base, taken[on], base[ids[on, k]])
        good = on[rival.max(1) < sims[on, k]]
        taken[good, count[good]] = ids[good, k]
        chosen[good, k] = True
        count[good] += 1
    rest = (ids >= 0) & ~chosen
    room = (most - count + 1) // 2
    fill = rest & (np.cumsum(rest, axis=1) <= room[:, None])
    rows, cols = np.nonzero(fill)
    at = count[rows] + (np.cumsum(fill, axis=1)[rows, cols] - 1)
    taken[rows, at] = ids[rows, cols]
    return taken


def build(vectors: np.ndarray, keys: np.ndarray) -> Graph:
    """A graph over the vectors. keys: a number for each, whose hash gives its level."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    base = np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
    n = len(base)
    chance = (mix(keys.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    level = np.minimum(np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(M)).astype(np.int64), 6)
    order = np.argsort(-level, kind="stable")  # the upper levels stand before the lower ones are linked
    top = int(level[order[0]])
    graph = Graph(base, [np.full((n + 1, 2 * M if k == 0 else M), -1, np.int32) for k in range(top + 1)], int(order[0]))
    for k in range(top, -1, -1):
        own = order[level[order] >= k]
        near = graph.levels[k]
        most = near.shape[1]
        at = 0
        while at < len(own):
            batch = own[at : at + max(32, min(BATCH, at))]
            q = base[batch]
            inner = q @ q.T
            np.fill_diagonal(inner, -np.inf)
            width = min(M * 2, len(batch) - 1)
            best = np.argsort(-inner, axis=1, kind="stable")[:, :width]
            ids, sims = batch[best], np.take_along_axis(inner, best, 1)
            if at:
                start = np.full((len(batch), 1), graph.entry)
                for upper in range(top, k, -1):
                    start = graph.beam(upper, q, start[:, :8], 8)[0]
                known, known_sims = graph.beam(k, q, start[:, :8], EF_BUILD)
                known = np.where(known == batch[:, None], -1, known)
                ids, sims = np.concatenate([ids, known], axis=1), np.concatenate([sims, np.where(known < 0, -np.inf, known_sims)], axis=1)
            rank = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
            near[batch, :M] = choose(base, batch, ids, sims, M)
            _link_back(base, near, batch, most)
            at += len(batch)
        near[n] = -1
    return graph


def _link_back(base: np.ndarray, near: np.ndarray, batch: np.ndarray, most: int) -> None:
    rows, cols = np.nonzero(near[batch] >= 0)
    to, source = near[batch[rows], cols].astype(np.int64), batch[rows]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    nodes, first, n = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(nodes), int(n.max()) if len(n) else 0), -1, np.int64)
    place = np.arange(len(to)) - np.repeat(first, n)
    extra[np.repeat(np.arange(len(nodes)), n), place] = source
    ids = np.sort(np.concatenate([near[nodes].astype(np.int64), extra], axis=1), axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    count = (ids >= 0).sum(1)
    ids = -np.sort(-ids, axis=1)
    few = count <= most
    near[nodes[few]] = np.pad(ids[few], ((0, 0), (0, max(0, most - ids.shape[1]))), constant_values=-1)[:, :most]
    many = np.flatnonzero(~few)
    for a in range(0, len(many), 256):
        of = many[a : a + 256]
        sims = _sims(base, ids[of], base[nodes[of]])
        rank = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * most]
        own, sims = np.take_along_axis(ids[of], rank, 1), np.take_along_axis(sims, rank, 1)
        near[nodes[of]] = choose(base, nodes[of], own, sims, most)


_INDEX = "dim int, shard long, n long, ids binary, heads binary, vectors binary, base binary, entry long, levels array<binary>"


def _index_row(dim: int, shard: int, ids: np.ndarray, vectors: np.ndarray) -> pa.Table:
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order] + 0.0  # -0.0 is 0.0
    pairs = np.concatenate([ids.view(np.uint8).reshape(len(ids), -1), vectors.view(np.uint8).reshape(len(ids), -1)], axis=1)
    _, once = np.unique(pairs.view(f"V{pairs.shape[1]}").ravel(), return_index=True)
    ids, vectors = ids[np.sort(once)], vectors[np.sort(once)]
    _, first, which = np.unique(vectors.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    heads = np.searchsorted(which[order], np.arange(len(first) + 1))
    distinct = vectors[first]
    graph = build(distinct, ids[first])
    row = {
        "dim": [dim], "shard": [shard], "n": [len(distinct)], "ids": [ids[order].tobytes()], "heads": [heads.astype("<i8").tobytes()], "vectors": [distinct.tobytes()],
        "base": [graph.base.tobytes()], "entry": [graph.entry], "levels": [[x.tobytes() for x in graph.levels]],
    }
    kinds = dict(zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()))))
    return pa.table(row, pa.schema(kinds.items()))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (as doubles) and dim of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def index(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a shard, from usable() rows."""
    counts = F.broadcast(rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards")))  # one row a length of vectors
    dealt = rows.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), "shards")).select("dim", "shard", "id", "vector")

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        return _index_row(key[0].as_py(), key[1].as_py(), table.column("id").to_numpy(), np.ascontiguousarray(vectors, np.float64))

    return dealt.groupBy("dim", "shard").applyInArrow(each, _INDEX)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of largest inner product found for each row that `queries` holds for."""
    rows = written(usable(vectors, id_col, vector_col))
    shards = written(index(rows, shard))
    asked = written(usable(vectors.where(queries), id_col, vector_col))
    cores = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    per_dim = asked.groupBy("dim").agg(F.count("*").alias("asked")).join(shards.groupBy("dim").agg(F.count("*").alias("shards")), "dim")  # one row a length
    few = F.least(F.ceil(F.lit(cores) / F.col("shards")), F.ceil(F.col("asked") / FEWEST))
    blocks = per_dim.select("dim", F.greatest(F.ceil(F.col("asked") / QUERIES), few).cast("long").alias("blocks"))
    where = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    dealt = asked.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).join(F.broadcast(where), "dim")
    dealt = dealt.select("dim", F.explode("shards").alias("shard"), "block", "id", "vector")
    copies = shards.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def each(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        row = {c: held.column(c)[0].as_py() for c in ("dim", "n", "ids", "heads", "vectors", "base", "entry", "levels")}
        dim, n = row["dim"], row["n"]
        levels = [np.frombuffer(x, np.int32).reshape(n + 1, -1) for x in row["levels"]]
        graph = Graph(np.frombuffer(row["base"], np.float32).reshape(n, dim + 1), levels, row["entry"])
        exact = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        ids, heads = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["heads"], np.int64)
        own = asked.column("id").to_numpy()
        q = asked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim).astype(np.float64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(own), 256):
            part = q[a : a + 256]
            found, _ = graph.search(np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32), min(ef, n))
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                score = exact[nodes] @ part[i]
                size = np.minimum(heads[nodes + 1] - heads[nodes], k + 1)  # ids of a node are in order: no later one can count
                flat = np.repeat(heads[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                near, score = ids[flat], np.repeat(score, size)
                keep = near != own[a + i]
                near, score = near[keep], score[keep]
                best = np.lexsort((near, -score))[:k]
                out.append((np.full(len(best), own[a + i]), near[best], score[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    by = ["dim", "shard", "block"]
    found = dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(each, "query_id long, vec_id long, score double")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
