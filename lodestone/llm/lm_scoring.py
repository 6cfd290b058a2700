"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

log P(text) is the sum over its tokens of log P(class | history) + log P(leaf | class, history) + log P(token | leaf).
Each of WIDE classes has WIDE leaves. The first OWN_CLASSES classes hold the most frequent tokens, the end among them,
one a leaf; all other tokens stand in the class of their last two bytes and the leaf of their hash. Both softmaxes are
of maximum entropy, over sums of hashed weights of three features: the token before (n-gram), the two before (n-gram),
and the one before that alone (skip); within a class the features are those together with the class, so that they tell
tokens of one class apart. P(token | leaf) is 1 for a token of its own, else the token's smoothed share of its leaf
among all training tokens, with one part for all unknown ones; so the model's probabilities sum to 1.

1. Rows are written to the shared folder in parts of bounded bytes.
2. Every part hands each of its distinct tokens with its training count to ranges of hash, where counts of the whole
   corpus are summed; these come back to each part for its own tokens. Nothing that grows is broadcast or collected.
3. Weights start at 0 over the leaves' counts. In each of ROUNDS rounds tasks count, for each weight, how often it was
   met and how often the model expects it, over a ROUNDS-th of the training texts (by a hash of the row); the sums over
   all tasks give one gradient step in logs, that of iterative scaling, drawn towards the model by PRIOR. Every training
   text is used once, and as sums don't depend on how rows are dealt to tasks, neither do weights and scores. What is
   broadcast is the weights, of fixed size.
4. Parts meet their counts, and texts are scored in sparse numpy batches.

A null or empty text is the end token alone. A null id is never held out. Repeated rows are scored (and counted) each.
Without any training text N and V are 0 and every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import Texts, Words, mix, slices, spaced
from lodestone.llm.tasks import partitions, small_batches, written

_U = np.uint64
#: Classes, and leaves of each.
WIDE = 32
#: Classes whose leaves are the most frequent tokens, and how many these are.
OWN_CLASSES = 16
OWN = OWN_CLASSES * WIDE
#: Rows of weights for each of the three kinds of feature, of classes and of leaves.
HASHED = 1 << 12, 1 << 13
ROUNDS = 3
#: Part of the way to the observed counts that the first step and the later ones go, and the weight of the model's own
#: expectation in each row of weights, in tokens.
FIRST, RATE, PRIOR = 0.5, 1 / 3, 100.0
#: Tokens that are scored at once.
BATCH = 16384
PART_BYTES = 16 << 20
END, BEFORE = _U(0x5851F42D4C957F20), _U(0x14057B7EF767814F)
#: The bits of a token's key that hold its ending; all others are the word's hash.
_ENDING = _U(0x1FF)
#: The logarithm of a leaf that no token has.
_NEVER = -1e9
#: Rows of weights that are added up together, and tasks that are in each step.
BLOCK, ADDED = 512, 64


class Tokens:
    """Tokens of a slice's rows, the end of each included: keys (the ending in the lowest bits) and rows."""

    def __init__(self, texts: Texts):
        words = Words(texts, spaced())
        last = words.lower[words.ends - 1].astype(_U)
        before = np.where(words.ends - words.starts > 1, words.lower[words.ends - 2], 0).astype(_U)
        ending = mix(last * _U(256) + before) & _ENDING
        self.n = words.counts + 1
        self.row = np.repeat(np.arange(texts.n), self.n)
        self.key = np.full(len(self.row), END)
        self.key[np.arange(len(words.hash)) + words.row] = (words.hash & ~_ENDING) | ending
        self.heads = np.cumsum(self.n) - self.n

    def history(self) -> np.ndarray:
        """Hashes of each token's three features."""
        one = np.concatenate([[BEFORE], self.key[:-1]])
        one[self.heads] = BEFORE
        two = np.concatenate([[BEFORE], one[:-1]])
        two[self.heads] = BEFORE
        with np.errstate(over="ignore"):
            return np.stack([mix(one), mix(two ^ _U(0xBADC0FFEE)), mix(one * _U(31) + two)])


def usual_leaf(key: np.ndarray) -> np.ndarray:
    """Leaves of tokens that have none of their own."""
    of = OWN_CLASSES + (key & _ENDING).astype(np.int64) % (WIDE - OWN_CLASSES)
    return of * WIDE + (mix(key) % _U(WIDE)).astype(np.int64)


def _rows(history: np.ndarray, leaf: np.ndarray) -> list[np.ndarray]:
    """For classes and for leaves, the rows of weights of each token's features."""
    with np.errstate(over="ignore"):
        inner = mix(history * _U(WIDE) + (leaf // WIDE).astype(_U))
    return [(h & _U(size - 1)).astype(np.uint16) for h, size in zip((history, inner), HASHED)]


def _stored(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("part", T.LongType()), *rows.schema.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for texts in slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(texts.n, part)), *batch.slice(texts.first, texts.n).columns], names=schema.names)
                size += len(texts.data)
                if size >= PART_BYTES:
                    part, size = part + 1, 0

    return written(rows.mapInArrow(each, schema))


def _own_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each part in a batch."""
    part = batch.column(0).to_numpy()
    for p in np.unique(part).tolist():
        yield p, batch if (part == p).all() else batch.filter(pa.array(part == p))


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, which compression shortens where they are small."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _counted(stored: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Per part, its tokens with their training counts in the whole corpus; and per range the numbers for each leaf."""
    bits = ranges.bit_length() - 1

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        now, size = -1, 0

        def flush() -> pa.RecordBatch:
            key, train = (np.concatenate(x) for x in zip(*kept))
            key, which = np.unique(key, return_inverse=True)
            n = np.bincount(which, weights=train, minlength=len(key)).astype(np.int64)
            bucket = (key >> _U(64 - bits)).astype(np.int64)
            found, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(key))
            return pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(len(found), now)), *(pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()) for x in (key, n.astype("<u4")))],
                names=["bucket", "part", "keys", "n"],
            )

        for batch in batches:
            for part, rows in _own_rows(batch):
                if part != now and kept:
                    yield flush()
                    kept.clear()
                now = part
                for texts in slices(rows.column(3)):
                    tokens = Tokens(texts)
                    learn = ~rows.column(2).slice(texts.first, texts.n).to_numpy(zero_copy_only=False)
                    key, which = np.unique(tokens.key, return_inverse=True)
                    kept.append((key, np.bincount(which, weights=learn[tokens.row], minlength=len(key))))
        if kept:
            yield flush()

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")]
        all_keys, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(all_keys), np.int64)
        np.add.at(n, which, np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("n")]).astype(np.int64))
        own = np.split(n[which], np.cumsum([len(k) for k in keys])[:-1])
        leaf = usual_leaf(all_keys)
        sums = np.zeros((2, WIDE * WIDE), "<i8")
        np.add.at(sums[0], leaf, n)
        np.add.at(sums[1], leaf, n > 0)
        top = np.argsort(-n, kind="stable")[:OWN]
        return pa.table(
            {
                "part": [*table.column("part").to_pylist(), -1],
                "keys": [*(k.tobytes() for k in keys), all_keys[top].tobytes()],
                "n": [*(_planes(k) for k in own), n[top].astype("<i8").tobytes()],
                "sums": [*[None] * len(keys), sums.tobytes()],
            },
            pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("sums", pa.binary())]),
        )

    given = stored.mapInArrow(hand_out, "bucket long, part long, keys binary, n binary")
    back = written(given.groupBy("bucket").applyInArrow(add, "part long, keys binary, n binary, sums binary"))
    return back.where("part >= 0").select("part", "keys", "n"), back.where("part = -1")


class Model:
    """own: keys of the tokens with a leaf of their own, in the order of these; size and kinds: training tokens and distinct
    ones of each usual leaf."""

    def __init__(self, own: np.ndarray, own_counts: np.ndarray, size: np.ndarray, kinds: np.ndarray):
        self.total, self.distinct = int(size.sum()), int(kinds.sum())
        size, kinds = size.copy(), kinds.copy()
        usual = usual_leaf(own)
        np.subtract.at(size, usual, own_counts)
        np.subtract.at(kinds, usual, (own_counts > 0).astype(np.int64))
        self.size, self.kinds = size, kinds
        order = np.argsort(own)
        self.own, self.own_leaf = own[order], order
        counts = size + 0.5
        counts[:OWN] = 0
        counts[: len(own)] = own_counts + 0.5
        counts = counts.reshape(WIDE, WIDE)
        sums = counts.sum(1, keepdims=True)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), _NEVER)
        #: Logs of shares of classes (one row for all tokens), and of leaves in each class.
        self.bias = log(sums.T / sums.sum()).astype(np.float32), log(counts / np.maximum(sums, 1e-300)).astype(np.float32)
        self.weights = tuple(np.zeros((3, size, WIDE), np.float32) for size in HASHED)

    def leaf(self, key: np.ndarray) -> np.ndarray:
        out = usual_leaf(key)
        if len(self.own):
            at = np.searchsorted(self.own, key)
            at[at == len(self.own)] = 0
            hit = self.own[at] == key
            out[hit] = self.own_leaf[at[hit]]
        return out

    def logits(self, level: int, rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """rows: those of the level's features, by kind."""
        w = self.weights[level]
        x = w[0][rows[0]]
        x += w[1][rows[1]]
        x += w[2][rows[2]]
        x += self.bias[level][leaf // WIDE if level else 0]
        return x

    def log_leaves(self, history: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural logs of P(class | history) P(leaf | class, history)."""
        out = np.zeros(len(leaf))
        for level, rows in enumerate(_rows(history, leaf)):
            goal = leaf % WIDE if level else leaf // WIDE
            for a in range(0, len(leaf), BATCH):
                x = self.logits(level, rows[:, a : a + BATCH], leaf[a : a + BATCH])
                top = x.max(1)
                out[a : a + BATCH] += x[np.arange(len(x)), goal[a : a + BATCH]] - top - np.log(np.exp(x - top[:, None]).sum(1))
        return out

    def log_tokens(self, leaf: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural logs of P(token | leaf)."""
        share = (counts + 0.5) / (self.size[leaf] + 0.5 * (self.kinds[leaf] + 1))
        return np.where(leaf < OWN, 0.0, np.log(share))


class Moments:
    """How often each weight was met, and how often the model expects it."""

    def __init__(self, model: Model):
        self.model = model
        self.met = [np.zeros((3, size * WIDE), np.int64) for size in HASHED]
        self.expected = [np.zeros((3, size, WIDE)) for size in HASHED]

    def add(self, history: np.ndarray, leaf: np.ndarray) -> None:
        for level, rows in enumerate(_rows(history, leaf)):
            goal = leaf % WIDE if level else leaf // WIDE
            for k in range(3):
                self.met[level][k] += np.bincount(rows[k].astype(np.int64) * WIDE + goal, minlength=HASHED[level] * WIDE)
            for a in range(0, len(leaf), BATCH):
                own = rows[:, a : a + BATCH]
                x = self.model.logits(level, own, leaf[a : a + BATCH])
                x -= x.max(1, keepdims=True)
                np.exp(x, out=x)
                x /= x.sum(1, keepdims=True)
                for k in range(3):
                    order = np.argsort(own[k], kind="stable")
                    at = own[k][order]
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    self.expected[level][k][at[first]] += np.add.reduceat(x[order], first)


def step(met: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """What weights (rows by WIDE) gain in a round."""
    n = met.sum(1, keepdims=True)
    share = expected / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = rate * np.log((met + PRIOR * share) / (expected + PRIOR * share))
    return np.where((n > 0) & (expected > 1e-12 * n), gain, 0.0).astype(np.float32)


def _model(sums: DataFrame) -> Model:
    """From one bounded row a range: frequent tokens, and numbers for each usual leaf."""
    one = written(sums.select("keys", "n", "sums"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, "<i8")), pa.array(np.frombuffer(n, "<i8"))], names=["key", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WIDE * WIDE), np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, "<i8").reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], WIDE * WIDE)), pa.array(np.tile(np.arange(WIDE * WIDE), 2)), pa.array(total.ravel())], names=["kind", "leaf", "n"])

    top = one.select("keys", "n").mapInArrow(pairs, "key long, n long").where("n > 0").orderBy(F.desc("n"), "key").limit(OWN).collect()
    chosen = {r.key: r.n for r in top}
    end = int(END.astype(np.int64))
    if end not in chosen:
        if len(chosen) == OWN:
            chosen.popitem()
        found = one.select("keys", "n").mapInArrow(pairs, "key long, n long").where(F.col("key") == end).agg(F.sum("n")).first()[0]
        chosen[end] = found or 0
    numbers = np.zeros((2, WIDE * WIDE), np.int64)
    for r in one.select("sums").mapInArrow(add, "kind long, leaf long, n long").groupBy("kind", "leaf").agg(F.sum("n").alias("n")).collect():
        numbers[r.kind, r.leaf] = r.n
    return Model(np.array(list(chosen), np.int64).view(_U), np.array(list(chosen.values()), np.int64), numbers[0], numbers[1])


_MOMENTS = pa.schema([("level", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("lot", pa.int64()), ("met", pa.binary()), ("expected", pa.binary())])
_GAINS = pa.schema([*list(_MOMENTS)[:3], ("gain", pa.binary())])


def _round(stored: DataFrame, model: Model, number: int) -> None:
    """Moves the weights by one round."""
    sent = stored.sparkSession.sparkContext.broadcast(model)
    rate = FIRST if number == 0 else RATE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = Moments(sent.value)
        for batch in batches:
            for texts in slices(batch.column(0)):
                tokens = Tokens(texts)
                moments.add(tokens.history(), sent.value.leaf(tokens.key))
        lot = TaskContext.get().partitionId()
        for level, (met, expected) in enumerate(zip(moments.met, moments.expected)):
            for k in range(3):
                for a in range(0, HASHED[level], BLOCK):
                    own = met[k][a * WIDE : (a + BLOCK) * WIDE]
                    if own.any():
                        values = (level, k, a, lot, _planes(own), expected[k][a : a + BLOCK].astype("<f4").tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _MOMENTS.types)], schema=_MOMENTS)

    def sums(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
        met, expected = np.zeros(BLOCK * WIDE, np.int64), np.zeros(BLOCK * WIDE)
        for a, b in zip(table.column("met"), table.column("expected")):
            met += _numbers(a.as_py())
            expected += np.frombuffer(b.as_py(), kind)
        return met, expected

    def merged(kind: str):
        def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            met, expected = sums(table, kind)
            return pa.table([[v] for v in (*(k.as_py() for k in key), _planes(met), expected.tobytes())], schema=_MOMENTS)

        return add

    def stepped(kind: str):
        def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            met, expected = sums(table, kind)
            gain = step(met.reshape(-1, WIDE), expected.reshape(-1, WIDE), rate)
            return pa.table([[v] for v in (*(k.as_py() for k in key), gain.astype("<f4").tobytes())], schema=_GAINS)

        return add

    own = stored.where(f"not held_out and pmod(xxhash64(id, text), {ROUNDS}) = {number}").select("text")
    fields = "level int, kind int, block int, lot long, met binary, expected binary"
    found, kind, lots = own.mapInArrow(count, fields), "<f4", partitions(own)
    while lots > ADDED:  # so that no task adds up more than ADDED of them
        found = found.withColumn("lot", F.floor(F.col("lot") / ADDED)).groupBy("level", "kind", "block", "lot").applyInArrow(merged(kind), fields)
        kind, lots = "<f8", -(-lots // ADDED)
    moved = found.groupBy("level", "kind", "block").applyInArrow(stepped(kind), "level int, kind int, block int, gain binary").collect()  # weights, of fixed size
    for r in moved:
        model.weights[r.level][r.kind, r.block : r.block + BLOCK] += np.frombuffer(r.gain, "<f4").reshape(-1, WIDE)
    sent.unpersist()


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the model), in log10."""
    kind = docs.schema[id_col]
    stored = _stored(docs, held_out, id_col, text_col)
    n_parts = stored.select("part").distinct().count()
    lookups, sums = _counted(stored, 1 << max(6, int(np.ceil(np.log2(max(1, n_parts))))))
    model = _model(sums)
    for number in range(ROUNDS):
        _round(stored, model, number)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
    schema = T.StructType([T.StructField(id_col, kind.dataType), *(T.StructField(c, t) for c, t in fields)])
    to_arrow = pa.schema([(c, t) for c, t in zip(schema.names[1:], (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))])

    def each(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        m = sent.value
        keys = np.concatenate([np.zeros(0, _U), *(np.frombuffer(x.as_py(), "<u8") for x in found.column("keys"))])
        n = np.concatenate([np.zeros(0, np.int64), *(_numbers(x.as_py()) for x in found.column("n"))])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        rows = rows.combine_chunks()
        out = []
        for texts in slices(rows.column("text")):
            tokens = Tokens(texts)
            count = n[np.searchsorted(keys, tokens.key)]
            leaf = m.leaf(tokens.key)
            base = np.log10((count + 0.5) / (m.total + 0.5 * (m.distinct + 1)))
            own = (m.log_leaves(tokens.history(), leaf) + m.log_tokens(leaf, count)) / np.log(10)
            add = lambda x: np.bincount(tokens.row, weights=x, minlength=texts.n)  # noqa: B023, E731
            part = rows.slice(texts.first, texts.n)
            columns = [part.column("held_out").combine_chunks(), tokens.n, add(count > 0).astype(np.int64), np.full(texts.n, m.total), add(base), add(own)]
            out.append(pa.table([part.column("id").combine_chunks(), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)], names=schema.names))
        return pa.concat_tables(out) if out else pa.table([rows.column("id"), *(pa.array([], f.type) for f in to_arrow)], names=schema.names)

    return stored.groupBy("part").cogroup(lookups.groupBy("part")).applyInArrow(each, schema)
