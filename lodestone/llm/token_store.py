"""Token files with Re-Pair grammars: ids of many documents on disk, any document decoded by itself.

Documents are dealt by ranges of id and of a hash of their text, so that one id of very many rows is no single task's,
and stand in ascending order (null ids first, then ties by that hash). A task gathers the ids of consecutive documents
into blocks of bounded size. In a block the most frequent pairs of neighbouring ids are replaced by new symbols, again
and again until no pair occurs LEAST times; no pair reaches across documents. Each round counts all pairs anew and takes
those at least a quarter as frequent as the most frequent one; where two of them touch, the more frequent is replaced. A
block is one row of the files:

- `symbols`: the reduced sequence, as little-endian 16- or 32-bit numbers (`width`);
- `rules`: two symbols for each new symbol, in the order in which they were made;
- `sizes`: how many ids each new symbol stands for, so that a place is found without expanding;
- `doc_id`, `heads`, `starts`: per document its id, first symbol, and ids before it in the part;
- `part`, `before`: the part (its number is its place in the order), and the ids before the block in it.

A null or empty text is a document of the end id alone. Repeated rows are kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import gather, word_bpe
from lodestone.llm.bytesio import slices
from lodestone.llm.tasks import shared_folder, small_batches

LEAST = 24
#: Slots in which pairs are counted roughly first, as a power of two.
SLOTS = 19
#: Ids in a block, but for a longer document.
BLOCK = 1 << 20


def repair(ids: np.ndarray, lengths: np.ndarray, base: int, rounds: int | None = None, rules: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols of each document, and rules (n by 2) of a block. base: the first new symbol. rounds and rules, if
    given, are the most rounds and the most rules of each."""
    seq = ids.astype(np.uint32)
    ends = np.zeros(len(seq), bool)
    ends[np.cumsum(lengths) - 1] = True
    made: list[np.ndarray] = []
    count, most = 0, len(seq)
    while len(seq) > 1 and (rounds is None or len(made) < rounds):
        size = base + count
        inside = ~ends[:-1]
        if size <= 1 << 16:  # pairs fit in 32 bits
            key = seq[:-1] * np.uint32(size) + seq[1:]
            slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)
        else:
            key = seq[:-1].astype(np.uint64) * np.uint64(size) + seq[1:]
            slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.uint32)
        rough = np.bincount(slot[inside], minlength=1 << SLOTS)
        # a slot's count bounds those of its pairs: this round's bound goes down until a pair reaches it
        most = min(most, int(rough.max()))
        while most >= least:
            bound = max(least, (most + 3) // 4)
            maybe = np.flatnonzero((rough >= bound)[slot] & inside)
            found, n = np.unique(key[maybe], return_counts=True)
            most = int(n.max()) if len(n) and n.max() >= bound else bound - 1
            if most >= bound:
                break
        if most < least:
            break
        keep = n >= max(least, (most + 3) // 4)
        found, n = found[keep], n[keep]
        order = np.lexsort((found, -n))[:rules]  # the most frequent first
        found = found[order]
        # of pairs in one slot, the most frequent; others wait for the next round
        own = ((found * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)) if size <= 1 << 16 else ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.uint32)
        table = np.zeros(1 << SLOTS, np.int32)
        table[own[::-1]] = np.arange(len(found) - 1, -1, -1)
        rule = table[slot[maybe]]
        hit = found[rule] == key[maybe]
        place, rule = maybe[hit], rule[hit]
        # of places of one pair that touch (as in aaaa), every other one; of others that touch, the more frequent pair
        touch = np.diff(place) == 1
        same = np.append(False, touch & (rule[1:] == rule[:-1]))
        if same.any():
            which = np.arange(len(place)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))
            place, rule = place[which % 2 == 0], rule[which % 2 == 0]
            touch = np.diff(place) == 1
        before = rule[1:] < rule[:-1]
        stays = np.ones(len(place), bool)
        stays[:-1] &= ~(touch & before)
        stays[1:] &= ~(touch & ~before)
        place, rule = place[stays], rule[stays]
        number = np.cumsum(np.bincount(rule, minlength=len(found)) > 0) - 1
        seq[place] = size + number[rule]
        ends[place] = ends[place + 1]
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        seq, ends = seq[stay], ends[stay]
        used = found[np.unique(rule)].astype(np.int64)
        made.append(np.stack([used // size, used % size], axis=1))
        count += len(used)
    counts = np.diff(np.concatenate([[0], np.flatnonzero(ends) + 1]))
    return seq.astype(np.int64), counts, np.concatenate(made) if made else np.zeros((0, 2), np.int64)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the new symbols' expansions, and these one after another."""
    whole: list[np.ndarray] = []
    for left, right in rules.tolist():
        whole.append(np.concatenate([whole[x - base] if x >= base else np.array([x]) for x in (left, right)]))
    sizes = np.array([len(x) for x in whole], np.int64)
    return sizes, np.concatenate(whole) if whole else np.zeros(0, np.int64)


class Block:
    """A block as it is read: any of its documents can be decoded alone."""

    def __init__(self, symbols: bytes, width: int, rules: bytes, sizes: bytes, base: int):
        self.symbols = np.frombuffer(symbols, f"<u{width}").astype(np.int64)
        pairs = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
        lengths, flat = expansions(pairs, base)
        assert np.array_equal(lengths, np.frombuffer(sizes, "<u4")), "the stored expansion lengths don't fit the rules"
        # one table for plain ids and new symbols
        self.flat = np.concatenate([np.arange(base), flat])
        self.sizes = np.concatenate([np.ones(base, np.int64), lengths])
        self.heads = np.cumsum(self.sizes) - self.sizes

    def decode(self, start: int, end: int) -> np.ndarray:
        """The ids that symbols start to end - 1 stand for."""
        own = self.symbols[start:end]
        return gather(self.flat, self.heads[own], self.sizes[own])

    def ids(self, start: int, end: int, first: int, count: int) -> np.ndarray:
        """Ids first to first + count - 1 of the document of symbols start to end - 1: the symbols that hold them are found
        by the sizes, and only these are expanded."""
        after = np.cumsum(self.sizes[self.symbols[start:end]])
        count = max(0, min(count, int(after[-1]) - first if len(after) else 0))
        if not count:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(after, [first, first + count - 1], "right")
        skip = first - (int(after[a - 1]) if a else 0)
        return self.decode(start + a, start + b + 1)[skip : skip + count]


_LISTS = (("doc_id", pa.int64()), ("heads", pa.int64()), ("starts", pa.int64()))
_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("part", "block", "before", "n_tokens", "base", "width")]
    + [T.StructField(c, T.BinaryType()) for c in ("symbols", "rules", "sizes")]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c, _ in _LISTS]
)


def write(docs: DataFrame, vocabulary: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Writes the files to a folder. Ids of documents must be whole numbers."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        part, number, before, base = TaskContext.get().partitionId(), 0, 0, bpe.size
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            names = [x for own, _, _ in kept for x in own]
            ids, lengths = (np.concatenate([k[i] for k in kept]) for i in (1, 2))
            kept.clear()
            seq, counts, rules = repair(ids, lengths, base)
            sizes, _ = expansions(rules, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            starts = before + np.cumsum(lengths) - lengths
            row = [part, number, before, int(lengths.sum()), base, width, seq.astype(f"<u{width}").tobytes(), rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()]
            row += [names, (np.cumsum(counts) - counts).tolist(), starts.tolist()]
            number, before = number + 1, before + int(lengths.sum())
            kinds = [pa.int64()] * 6 + [pa.binary()] * 3 + [pa.list_(k) for _, k in _LISTS]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=_SCHEMA.names)

        size = 0
        for batch in batches:
            for texts in slices(batch.column(1)):
                ids, n = bpe.encode(texts)
                to = np.cumsum(n)
                whole = np.insert(ids, to, end_id)
                kept.append((batch.column(0).slice(texts.first, texts.n).to_pylist(), whole, n + 1))
                size += len(whole)
                if size >= block:
                    yield flush()
                    size = 0
        if kept:
            yield flush()

    ordered.mapInArrow(each, _SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, and ids_crc32 of its ids as little-endian 32-bit numbers."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "doc_id", "within", "n_tokens", "ids_crc32")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in _SCHEMA.names}
                block = _block({c: row[c].as_py() for c in ("symbols", "width", "rules", "sizes", "base")})
                ids, heads, starts = (row[c].values for c, _ in _LISTS)
                bounds = [*heads.to_pylist(), len(block.symbols)]
                sums = [zlib.crc32(block.decode(a, b).astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                n = np.diff(np.append(starts.to_numpy(), row["before"].as_py() + row["n_tokens"].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["part"].as_py())), ids, starts, pa.array(n), pa.array(sums, pa.int64())], names=schema.names)

    # one row for each part, of which there are as many as shuffle partitions
    parts = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    at, offsets = 0, []
    for part, n in parts:
        offsets.append((part, at))
        at += n
    before = spark.createDataFrame(offsets, "part long, parts_before long")
    found = blocks.mapInArrow(each, schema).join(F.broadcast(before), "part")
    return found.select("doc_id", (F.col("parts_before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _block(row: dict) -> Block:
    return Block(*(row[c] for c in ("symbols", "width", "rules", "sizes", "base")))


def fetch(spark, path: str, asked: DataFrame) -> DataFrame:
    """Random access: for each row of asked (doc_id, first, count), the ids from `first` (0: the document's first) on, up to
    `count` of them, as ids; nothing where there is no such document. Only blocks that hold one are read into tasks."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    places = blocks.select("part", "block", F.posexplode("doc_id").alias("place", "doc_id"))
    wanted = asked.select("doc_id", "first", "count").join(places, "doc_id")

    def each(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for row in held.to_pylist():
            block = _block(row)
            bounds = [*row["heads"], len(block.symbols)]
            for x in asked.to_pylist():
                out.append((x["doc_id"], x["first"], x["count"], block.ids(bounds[x["place"]], bounds[x["place"] + 1], x["first"], x["count"]).tolist()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["doc_id", "first", "count", "ids"])

    # one block's row may meet many questions, and each question all blocks that hold a document of its id
    wanted = wanted.select(F.col("part").alias("of_part"), F.col("block").alias("of_block"), "place", "doc_id", "first", "count")
    held = spark.read.schema(_SCHEMA).parquet(path)
    some = held.join(wanted.select("of_part", "of_block").distinct(), (F.col("part") == F.col("of_part")) & (F.col("block") == F.col("of_block")), "left_semi")
    return wanted.groupBy("of_part", "of_block").cogroup(some.groupBy("part", "block")).applyInArrow(each, "doc_id long, first long, count long, ids array<bigint>")


def stored_digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the documents' files to the shared folder and reads them back; see read()."""
    path = shared_folder(docs.sparkSession)
    write(docs, vocabulary, end_id, path)
    return read(docs.sparkSession, path)
