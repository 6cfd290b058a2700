"""Benchmark decontamination by winnowed fingerprints.

Both sides are cut into words. Of every 9 consecutive hashes of 5-word grams the least is kept as a fingerprint, so
that two texts that share any 13 words share a fingerprint there. Document fingerprints are joined with those of the
benchmark; each hit is extended to the 13-word windows around it, which count where their words are those of an item's
window. An item of fewer words is one window of its own length, and its fingerprint is the gram of that length.

The benchmark's index goes to the executors as a broadcast where the benchmark is at most `broadcast_bytes` of text,
which is checked first. Beyond that, document fingerprints are joined with benchmark fingerprints by shuffle, and only
the items that a document shares a fingerprint with come to it.

Null, empty and wordless texts have no words, no hits and are not contaminated. Repeated rows are answered each. An
item that repeats under several ids counts once for each id; items without an id are written as the empty string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import Texts, Words, alphanumeric, mix, slices
from lodestone.llm.tasks import by_slice, unused

WINDOW, GRAM = 13, 5
BROADCAST_BYTES = 32 << 20
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def grams(words: Words, size: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the runs of `size` words inside a row, or of those that start at the given words."""
    h = words.hash
    if first is None:
        n = max(0, len(h) - size + 1)
        first = np.flatnonzero(words.row[:n] == words.row[size - 1 : size - 1 + n])
    x = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = x * _FACTOR + h[first + k]
        return mix(x + np.uint64(size)), first


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their first words: the least gram hash of each run of grams that a window of words has."""
    g, first = grams(words, GRAM)
    span = WINDOW - GRAM + 1
    n = max(0, len(g) - span + 1)
    if not n:
        return g[:0], first[:0]
    least = g[:n].copy()
    for k in range(1, span):
        np.minimum(least, g[k : n + k], out=least)
    whole = (words.row[first[:n]] == words.row[first[span - 1 :]]) & (first[span - 1 :] - first[:n] == span - 1)
    chosen = np.zeros(len(g), bool)
    for k in range(span):
        chosen[k : n + k] |= whole & (g[k : n + k] == least)
    return g[chosen], first[chosen]


class Index:
    """Fingerprints and windows of benchmark items, by window length."""

    def __init__(self, ids: list[str], texts: pa.Array):
        wins: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = []
        for part in slices(texts):
            words = Words(part, alphanumeric())
            prints.append(winnow(words)[0])
            h, first = grams(words, WINDOW)
            wins.setdefault(WINDOW, []).append((h, words.row[first] + part.first))
            for size in np.unique(words.counts[(words.counts > 0) & (words.counts < WINDOW)]).tolist():
                row = np.flatnonzero(words.counts == size)
                h, _ = grams(words, size, words.heads[row])
                wins.setdefault(size, []).append((h, row + part.first))
        self.ids = ids
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {}
        for size, found in wins.items():
            h, item = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            self.windows[size] = (h[order], item[order])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word, whether a window covers it; and pairs of row and item, each once."""
        cover = np.zeros(len(words.hash) + 1, np.int64)
        rows, items = [], []
        for size, (known, item) in self.windows.items():
            if not len(known):
                continue
            if size == WINDOW:
                found, place = winnow(words)
                place = place[np.isin(found, self.prints)]
                start = np.unique((place[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                start = start[(start >= 0) & (start + size <= len(words.hash))]
                start = start[words.row[start] == words.row[start + size - 1]]
                h, start = grams(words, size, start)
            else:
                h, start = grams(words, size)
            left, right = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            hit = right > left
            start, left, n = start[hit], left[hit], (right - left)[hit]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + size, -1)
            # repeats of a window in a row name the same items: take each once
            key = np.unique(np.stack([words.row[start], left, n]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
            row, left, n = key
            rows.append(np.repeat(row, n))
            items.append(item[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        if not rows:
            return cover[:-1] > 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return np.cumsum(cover)[:-1] > 0, pairs[0], pairs[1]


def _report(index: Index, words: Words, ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    covered, rows, items = index.hits(words)
    n_hit = np.bincount(words.row[covered], minlength=words.n)
    named = [hashlib.sha256(b"").hexdigest()] * words.n
    n_items = np.zeros(words.n, np.int64)
    for row in np.unique(rows).tolist():
        own = sorted({index.ids[i] for i in items[rows == row].tolist()})
        n_items[row], named[row] = len(own), hashlib.sha256(",".join(own).encode()).hexdigest()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(words.counts), pa.array(n_hit), pa.array(n_items), pa.array(named, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= words.counts))],
        names=names,
    )


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _broadcast(items: DataFrame, most: int):
    """The benchmark's index for all executors, if it is at most so many bytes of text."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 16), F.lit(0))).first()[0]
    if size > most:
        return None
    rows = items.collect()  # of the size just checked
    return items.sparkSession.sparkContext.broadcast(Index([r.item for r in rows], pa.array([r.text for r in rows], pa.string())))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words are hit)."""
    docs = docs.select(id_col, F.col(text_col).alias("text"))
    items = _items(benchmark, item_col, text_col)
    fields = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in fields)])
    index = _broadcast(items, broadcast_bytes)
    if index is None:
        return _joined(docs, items, id_col, schema)

    def work(batch: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        return _report(index.value, Words(texts, alphanumeric()), batch.column(0), schema.names)

    return by_slice(docs, schema, work)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows, with all their columns, that are not contaminated."""
    items = _items(benchmark, item_col, text_col)
    index = _broadcast(items, broadcast_bytes)
    if index is None:
        key = F.sha2(F.coalesce(text_col, F.lit("")), 256)
        found = contamination(docs.select(key.alias("row"), text_col), benchmark, "row", text_col, item_col, broadcast_bytes)
        row = unused("contaminated_row", docs)
        bad = found.where("contaminated").select(F.col("row").alias(row))
        return docs.join(bad, key == F.col(row), "left_anti")

    def work(batch: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        words = Words(texts, alphanumeric())
        n_hit = np.bincount(words.row[index.value.hits(words)[0]], minlength=words.n)
        return batch.filter(pa.array((n_hit == 0) | (20 * n_hit < words.counts)))

    return by_slice(docs, docs.schema, work, text_col)


def _fingerprints(rows: DataFrame, key: str, sizes: list[int], short: bool) -> DataFrame:
    """The distinct fingerprints of each row, with its key; of the given lengths, the grams of documents, or with
    `short` the whole of items that are so short."""

    def work(batch: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        words = Words(texts, alphanumeric())
        found, first = winnow(words)
        parts = [(found, words.row[first])]
        for size in sizes:
            of = np.flatnonzero(words.counts == size) if short else None
            h, first = grams(words, size, words.heads[of] if short else None)
            parts.append((h, words.row[first]))
        h, row = (np.concatenate(x) for x in zip(*parts))
        pairs = np.unique(np.stack([row.astype(np.uint64), h]), axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], names=[key, "print"])

    return by_slice(rows.select(key, "text"), T.StructType([T.StructField(key, T.StringType()), T.StructField("print", T.LongType())]), work)


def _lengths(rows: DataFrame) -> list[int]:
    """The lengths under WINDOW, of which there are few, that texts have in words."""

    def work(batch: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        counts = np.unique(Words(texts, alphanumeric()).counts)
        return pa.RecordBatch.from_arrays([pa.array(counts[(counts > 0) & (counts < WINDOW)])], names=["n"])

    return sorted(r.n for r in by_slice(rows.select("text"), "n long", work).distinct().collect())


def _joined(docs: DataFrame, items: DataFrame, id_col: str, schema: T.StructType) -> DataFrame:
    # equal texts are one: what is asked of a text doesn't depend on the row that holds it
    docs = docs.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = docs.select("row", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["row"])
    items = items.withColumn("item_row", F.sha2("text", 256))
    distinct = items.select("item_row", "text").dropDuplicates(["item_row"])
    sizes = _lengths(distinct)
    pairs = _fingerprints(texts, "row", sizes, False).join(_fingerprints(distinct, "item_row", sizes, True), "print").select("row", "item_row").distinct()
    needed = pairs.join(items.groupBy("item_row").agg(F.collect_set("item").alias("ids"), F.first("text").alias("item_text")), "item_row")
    inner = T.StructType([T.StructField("row", T.StringType()), *schema.fields[1:]])

    def each(own: pa.Table, near: pa.Table) -> pa.Table:
        ids, item_texts = [], []
        for names, text in zip(near.column("ids").to_pylist(), near.column("item_text").to_pylist()):
            ids += names
            item_texts += [text] * len(names)
        index = Index(ids, pa.array(item_texts, pa.string()))
        own = own.combine_chunks()
        parts = slices(own.column("text"))
        return pa.Table.from_batches([_report(index, Words(x, alphanumeric()), own.column("row").slice(x.first, x.n).combine_chunks(), inner.names) for x in parts])

    found = texts.groupBy("row").cogroup(needed.groupBy("row")).applyInArrow(each, inner)
    return docs.select(id_col, "row").join(found, "row").select(schema.names)
