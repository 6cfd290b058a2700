"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts texts where it has a given value, so that equal passages are cut alike wherever they
stand. The whole words inside a chunk are encoded once; a worker keeps the ids of chunks it has met, in bounded
memory. A cut may fall anywhere, so each join is repaired: the span around the cut is encoded again and widened until
both of its ends stand at white space, where the ids of both sides hold exactly (a chunk without white space is taken
into the join). Ids are those of the tokenizers library without added special tokens; special strings in a text are
found as the library finds them.

Null and empty texts have no ids and decode to the empty text. Rows that repeat are encoded each (from the same chunks).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.bpe import WordBpe, gather, word_bpe
from lodestone.llm.bytesio import Texts, hashes, mix
from lodestone.llm.tasks import by_slice

#: Mean bytes of a chunk, a power of two.
CHUNK = 512
#: Ids that a worker keeps in each of two generations of chunks.
KEPT_IDS = 3_000_000
_WINDOW = 16


@lru_cache(maxsize=1)
def _roll() -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, mean: int = CHUNK) -> np.ndarray:
    """Places where the rolling hash of the 16 bytes before them cuts."""
    h = _roll()[data]
    with np.errstate(over="ignore"):
        step, factor = 1, np.uint32(0x9E3779B1)
        while step < _WINDOW:
            low = h.copy()
            low[step:] += h[:-step] * factor
            h, factor, step = low, factor * factor, step * 2
    return np.flatnonzero(h >> np.uint32(33 - mean.bit_length()) == 0) + 1


class ChunkCodec:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.new: dict[int, np.ndarray] = {}
        self.old: dict[int, np.ndarray] = {}
        self.kept = 0
        self.encoded = self.reused = 0

    def spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that cut a slice into chunk insides and joins, each at white space or a row's end; whether the span
        that starts at a bound is a chunk's inside."""
        data, offsets = texts.data, texts.offsets
        space = (data == 32) | ((data >= 9) & (data <= 13))
        places = np.flatnonzero(space)
        edges = np.unique(np.concatenate([offsets, cuts(data)]))
        edges = edges[edges <= len(data)]
        is_row = np.zeros(len(data) + 1, bool)
        is_row[offsets] = True
        left, right = edges[:-1], edges[1:]
        padded = np.concatenate([places, [len(data) + 1]])
        first = np.where(is_row[left], left, padded[np.searchsorted(places, left, "left")])
        behind = np.concatenate([[-1], places])
        last = np.where(is_row[right], right, behind[np.searchsorted(places, right, "left")])
        inside = first < last
        first, last = first[inside], last[inside]
        bounds = np.concatenate([offsets, first, last])
        kinds = np.concatenate([np.zeros(len(offsets), bool), np.ones(len(first), bool), np.zeros(len(last), bool)])
        bounds, at = np.unique(bounds, return_inverse=True)
        chunk = np.zeros(len(bounds), bool)
        np.logical_or.at(chunk, at, kinds)
        return bounds, chunk[:-1]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice in turn, and how many each row has."""
        if not len(texts.data):
            return np.zeros(0, np.int32), np.zeros(texts.n, np.int64)
        bounds, chunk = self.spans(texts)
        starts, ends = bounds[:-1], bounds[1:]
        keys = np.zeros(len(starts), np.uint64)
        keys[chunk] = hashes(texts.data, starts[chunk], ends[chunk])
        found: list[np.ndarray | None] = [None] * len(starts)
        wanted, first_of = [], {}
        for i, (is_chunk, key) in enumerate(zip(chunk.tolist(), keys.tolist())):
            if not is_chunk:
                wanted.append(i)
            elif (ids := self.new.get(key)) is not None or (ids := self.old.get(key)) is not None:
                found[i] = ids
                self.reused += 1
            elif key not in first_of:
                first_of[key] = i
                wanted.append(i)
        at = np.array(wanted, np.int64)
        sizes = ends[at] - starts[at]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        ids, n = self.bpe.encode(Texts(gather(texts.data, starts[at], sizes), offsets, 0))
        self.encoded += len(first_of)
        for i, part in zip(wanted, np.split(ids, np.cumsum(n)[:-1])):
            found[i] = part
        for key, i in first_of.items():
            self.new[key] = found[i].copy()
            self.kept += len(found[i]) + 32
        for i, (is_chunk, key) in enumerate(zip(chunk.tolist(), keys.tolist())):
            if is_chunk and found[i] is None:
                found[i] = found[first_of[key]]
                self.reused += 1
        if self.kept > KEPT_IDS:
            self.old, self.new, self.kept = self.new, {}, 0
        counts = np.array([len(x) for x in found], np.int64)
        row = np.searchsorted(texts.offsets, starts, "right") - 1
        return np.concatenate(found), np.bincount(row, weights=counts, minlength=texts.n).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode with special tokens kept: for a vocabulary without a decoder, its tokens with a space between."""
        return b" ".join(map(self.bpe.spelled.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def chunk_codec(path: str) -> ChunkCodec:
    return ChunkCodec(word_bpe(path))


@lru_cache(maxsize=1)
def _decimal(size: int) -> list[bytes]:
    return [str(i).encode() for i in range(size)]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ids, an array of ints."""
    docs = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        ids, n = chunk_codec(vocabulary).encode(texts)
        heads = np.zeros(texts.n + 1, np.int32)
        np.cumsum(n, out=heads[1:])
        return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(heads), pa.array(ids))], names=schema.names)

    return by_slice(docs, schema, work, text_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of ids: the id and the decoded text; null for null ids."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def each(batches):
        codec = chunk_codec(vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(id_col, "ids").mapInArrow(each, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, and the SHA-256 of its ids in decimal and of what they decode to."""
    docs = docs.select(id_col, text_col)
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        codec = chunk_codec(vocabulary)
        ids, n = codec.encode(texts)
        decimal, to, of_ids, of_text = _decimal(codec.bpe.size), 0, [], []
        for size in n.tolist():
            own = ids[to : to + size]
            to += size
            of_ids.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, own.tolist()))).hexdigest())
            of_text.append(hashlib.sha256(codec.decode(own)).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(of_ids), pa.array(of_text)], names=schema.names)

    return by_slice(docs, schema, work, text_col)
