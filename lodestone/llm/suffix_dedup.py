"""Substring deduplication by suffix automata of reference shards.

Each word goes that a run of WINDOW words covers which also starts in a document of a lesser id. Words are taken as they
are; runs are judged on the input.

1. Of the GRAM-word hashes in a window the least is its anchor, so that equal windows have equal anchors. Anchors are
   counted over all documents by ranges of hash; a bitmap of fixed size tells which are in several rows. The others'
   windows are in no second document and are left.
2. Consecutive windows with one anchor are a context, of WINDOW to WINDOW + 8 words. Each distinct context of a slice of
   documents is written once, with the ids, texts and places it stands at. What all documents hold of a context is
   aggregated: the least and greatest id.
3. Distinct contexts are dealt to shards by their anchors' hashes. A shard takes one anchor after another, as contexts of
   different anchors have no window in common. Its contexts stream, in order of least id, through the suffix automaton of
   those before: matching statistics tell for each place the state of the longest match. A state is labelled with the
   document that first made it. A window that matches is answered with the label of the state of its last WINDOW words. A
   context with a window that doesn't match belongs to the reference, and the automaton grows by it. So each distinct
   window's least document is known to every context that holds it. An anchor in more than HOT_ROWS rows would make one
   shard large; its contexts are cut into single windows, which are dealt by their own hashes and have only themselves to
   match.
4. Contexts with a window of a lesser document than their greatest meet their places again; each document's spans are
   joined to its text, and covered words go. A bitmap of fixed size keeps most texts without spans out of that join.

What a shard holds grows with the corpus, and so is not broadcast to documents: contexts go to the shard that can match
them, and to no other. The bitmap (2^27 bits) and up to 2^20 hot anchors are all that is broadcast; once more anchors are
shared than the bitmap tells apart, more contexts are looked at, with the same results.

Null and empty texts have no words. A null id is less than none, and none is less than it: its words all stay. Repeated
rows of one id keep what they share with each other alone and are answered each. Ids compare by value. Words and
contexts are compared by 64-bit hashes (words inside an automaton as they are), texts of one id by 32 bits. Columns but the id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import Texts, Words, mix, slices
from lodestone.llm.ngram_join import BITS, Order, marked, shared_order
from lodestone.llm.tasks import by_slice, partitions, written

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
#: Rows that hold an anchor, from which on its windows are dealt one by one.
HOT_ROWS = 1024
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def _unchanged() -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return word, np.arange(256, dtype=np.uint8)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the grams at each word (those that leave a row are never used), and the first word and the anchor's word
    of each window."""
    h = words.hash
    if len(h) < WINDOW:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(len(h) - GRAM + 1, _U)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            g = g * _FACTOR + h[k : len(g) + k]
        g = mix(g)
    first = np.flatnonzero(words.row[: len(h) - WINDOW + 1] == words.row[WINDOW - 1 :])
    at = np.lib.stride_tricks.sliding_window_view(g, SPAN)[first].argmin(1) + first
    return g, first, at


def _counted(texts: Texts) -> tuple[np.ndarray]:
    """The distinct anchors of each row."""
    words = Words(texts, _unchanged())
    g, _, at = anchors(words)
    at = np.unique(at)
    h, row = g[at], words.row[at]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return (h[new],)


def contexts(words: Words, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, hash by which it is dealt (its anchor, or its own if it is a window alone), and own hash
    of each context with an anchor that may be shared."""
    g, first, at = anchors(words)
    may = order.shared(g[at]) if len(at) else np.zeros(0, bool)
    first, at = first[may], at[may]
    if not len(first):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U),) * 2
    anchor = g[at]
    hot = order.weight(anchor) > 0
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + 1) | (at[1:] != at[:-1]) | hot[1:]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(first)))
    first, anchor, hot = first[head], anchor[head], hot[head]
    x = np.zeros(len(head), _U)
    with np.errstate(over="ignore"):
        for k in range(WINDOW + SPAN - 1):
            on = np.flatnonzero(n + WINDOW - 1 > k)
            x[on] = x[on] * _FACTOR + words.hash[first[on] + k]
        x = mix(x + n.astype(_U))
    return first, n, np.where(hot, x, anchor), x


class Automaton:
    """The suffix automaton of word sequences that are added one after another; each state has the label of the sequence
    that first made it. Most states have one next state, which is held apart from the others' tables."""

    def __init__(self):
        self.length, self.link, self.label, self.word, self.to = [0], [-1], [None], [None], [0]
        self.more: dict[int, dict] = {}

    def _next(self, state: int, word) -> int:
        """The next state, 0 if there is none (nothing leads to the first)."""
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, 0) if state in self.more else 0

    def _put(self, state: int, word, to: int) -> None:
        if self.word[state] is None or self.word[state] == word:
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _new(self, length: int, link: int, label) -> int:
        self.length.append(length)
        self.link.append(link)
        self.label.append(label)
        self.word.append(None)
        self.to.append(0)
        return len(self.length) - 1

    def _split(self, before: int, word, state: int) -> int:
        """The state of what `before` and the word make, apart from the longer strings of `state`."""
        if self.length[state] == self.length[before] + 1:
            return state
        own = self._new(self.length[before] + 1, self.link[state], self.label[state])
        self.word[own], self.to[own] = self.word[state], self.to[state]
        if state in self.more:
            self.more[own] = dict(self.more[state])
        while before >= 0 and self._next(before, word) == state:
            self._put(before, word, own)
            before = self.link[before]
        self.link[state] = own
        return own

    def add(self, words: list, label) -> None:
        last = 0
        for w in words:
            if found := self._next(last, w):
                last = self._split(last, w, found)
                continue
            own = self._new(self.length[last] + 1, 0, label)
            at = last
            while at >= 0 and not (found := self._next(at, w)):
                self._put(at, w, own)
                at = self.link[at]
            if at >= 0:
                self.link[own] = self._split(at, w, found)
            last = own

    def windows(self, words: list, size: int) -> list:
        """Matching statistics, as the label of each run of `size` words that is in the automaton; else None."""
        length, link, out, state, matched = self.length, self.link, [], 0, 0
        for i, w in enumerate(words, 1):
            while not (found := self._next(state, w)) and state:
                state = link[state]
                matched = length[state]
            if found:
                state, matched = found, matched + 1
                while length[link[state]] >= size:
                    state = link[state]
                    matched = length[state]
            if i >= size:
                out.append(self.label[state] if matched >= size else None)
        return out


def least_documents(found: list[tuple]) -> list[list]:
    """For contexts of one anchor (least id, words): the least document of each of their windows."""
    automaton, out = Automaton(), [[]] * len(found)
    for i in sorted(range(len(found)), key=lambda i: found[i]):
        least, words = found[i]
        known = automaton.windows(words, WINDOW)
        if None in known:
            automaton.add(words, least)
        out[i] = [least if k is None else k for k in known]
    return out


def _candidates(docs: DataFrame, id_type: T.DataType, order, bits: int) -> DataFrame:
    """Of docs (id, digest, text), the distinct contexts of each slice: shard, key (its anchor), context, its bytes (none for a
    window alone), number of windows, and where it stands: ids in order, texts' digests, and first words."""
    fields = (("shard", T.LongType()), ("key", T.LongType()), ("context", T.LongType()), ("words", T.BinaryType()), ("n", T.IntegerType()))
    schema = T.StructType([*(T.StructField(c, t) for c, t in fields), T.StructField("ids", T.ArrayType(id_type)), T.StructField("digests", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch | None:
        words = Words(texts, _unchanged())
        first, n, key, own = contexts(words, order.value)
        if not len(first):
            return None
        row = words.row[first]
        rank = np.argsort(np.argsort(rows.column(0).to_pandas().to_numpy(), kind="stable"))  # ids in order, whatever their type
        at = np.lexsort((first, rank[row], own))
        first, n, key, own, row = (x[at] for x in (first, n, key, own, row))
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        data = texts.data.tobytes()
        begin, end = words.starts[first[head]].tolist(), words.ends[first[head] + n[head] + WINDOW - 2].tolist()
        ids = rows.column(0).take(pa.array(row))
        offsets = pa.array(np.append(head, len(own)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array((key[head] >> _U(64 - bits)).astype(np.int64)), pa.array(key[head].view(np.int64)), pa.array(own[head].view(np.int64)),
                pa.array([b"" if x else data[a:b] for a, b, x in zip(begin, end, (key[head] == own[head]).tolist())], pa.binary()), pa.array(n[head].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, rows.column(1).take(pa.array(row))),
                pa.ListArray.from_arrays(offsets, pa.array((first - words.heads[row]).astype(np.int32))),
            ],
            names=schema.names,
        )

    return by_slice(docs, schema, work)


def _answers(distinct: DataFrame, id_type: T.DataType) -> DataFrame:
    """Of distinct contexts (shard, key, context, words, n, least, most): those with a window that starts in a document before their
    greatest, with the least document of each window."""
    schema = T.StructType([T.StructField("of", T.LongType()), T.StructField("firsts", T.ArrayType(id_type))])

    def each(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("key").to_numpy(), kind="stable"))).combine_chunks()
        key, n = table.column("key").to_numpy(), table.column("n").to_pylist()
        least, most = table.column("least").to_pylist(), table.column("most").to_pylist()
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        keep, firsts = [], []
        for a, b in zip(head, [*head[1:], len(key)]):
            if b - a == 1:  # nothing else has its windows
                if least[a] < most[a]:
                    keep.append(a)
                    firsts.append([least[a]] * n[a])
                continue
            found = least_documents([(least[i], table.column("words")[i].as_py().split()) for i in range(a, b)])
            for i, own in zip(range(a, b), found):
                if any(d < most[i] for d in own):
                    keep.append(i)
                    firsts.append(own)
        return pa.table({"of": table.column("context").take(pa.array(keep, pa.int64())), "firsts": pa.array(firsts, pa.list_(table.schema.field("least").type))})

    return distinct.groupBy("shard").applyInArrow(each, schema)


def spans(docs: DataFrame) -> DataFrame:
    """Of docs (id, digest, text): id, digest and spans (start, mask), a set bit k of mask meaning that the window that starts
    at word start + k also starts in a document of a lesser id."""
    id_type = docs.schema["id"].dataType
    docs = docs.where("id is not null and text is not null")
    bits = int(np.clip(np.ceil(np.log2(8 * partitions(docs))), 8, BITS - 3))
    order = docs.sparkSession.sparkContext.broadcast(shared_order(docs, "text", bits, _counted, HOT_ROWS))
    found = written(_candidates(docs, id_type, order, bits))
    # dealt once: contexts of a shard are aggregated where they are matched
    distinct = found.select("shard", "key", "context", F.col("ids")[0].alias("least"), F.element_at("ids", -1).alias("most"), "n", "words").repartition("shard").groupBy("shard", "key", "context").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("n").alias("n"), F.max("words").alias("words"))
    answers = written(_answers(distinct, id_type))
    met = found.select("context", "ids", "digests", "starts").join(answers, F.col("context") == F.col("of"))
    places = met.select("firsts", F.explode(F.arrays_zip("ids", "digests", "starts")).alias("x")).select("firsts", "x.ids", "x.digests", "x.starts")
    bit = F.expr("aggregate(transform(firsts, (d, k) -> if(d < ids, shiftleft(1, k), 0)), 0, (a, b) -> a + b)")
    masks = places.select(F.col("ids").alias("id"), F.col("digests").alias("digest"), F.struct(F.col("starts").alias("start"), bit.alias("mask")).alias("span")).where("span.mask != 0")
    return masks.groupBy("id", "digest").agg(F.collect_set("span").alias("spans"))


def covered(n: int, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of n words the windows cover."""
    change = np.zeros(n + 1, np.int64)
    for k in range(SPAN):
        at = starts[(masks >> k) & 1 == 1] + k
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, n_removed, and kept: the words that stay, joined by one space."""
    own = docs.select(F.col(id_col).alias("id"), F.shiftright(F.xxhash64(text_col), 32).cast("int").alias("digest"), F.col(text_col).alias("text"))
    found = written(spans(own).select(F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), F.col("spans.start").alias("starts"), F.col("spans.mask").alias("masks")))
    bits = docs.sparkSession.sparkContext.broadcast(marked(found.select(F.xxhash64("of_id", "of_digest"))))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(bits.value[mix(key.to_numpy().view(_U)) >> _U(40)])

    own = own.withColumn("maybe", maybe(F.xxhash64("id", "digest")))
    met = own.where("maybe").join(found, (F.col("id") == F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left").select("id", "text", "starts", "masks")
    whole = own.where("not maybe").select("id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("masks"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                rows = batch.slice(texts.first, texts.n)
                words, removed, kept = [], [], []
                for i, (starts, masks) in enumerate(zip(rows.column(2), rows.column(3))):
                    own = texts.bytes(i).split()  # at the same characters that Words splits at
                    words.append(len(own))
                    if starts.is_valid:
                        gone = covered(len(own), starts.values.to_numpy(), masks.values.to_numpy())
                        own = [w for w, x in zip(own, gone.tolist()) if not x]
                    removed.append(words[-1] - len(own))
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return met.mapInArrow(each, schema).unionByName(whole.mapInArrow(each, schema))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, n_removed and kept_sha256."""
    kept = without_repeats(docs, id_col, text_col)
    return kept.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
