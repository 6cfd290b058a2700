"""Vectorised word splitting and hashing over the bytes of an Arrow text column.

Texts come to Python in Arrow batches; their UTF-8 bytes are read in place as one numpy array, so
that no Python object is made per word. A batch is cut into slices of bounded size first, which
bounds memory whatever the batch holds; a document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on every element."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """A random number for each byte at each of 64 places of a word."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 64 * 256 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _classes(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return word, lower


@lru_cache(maxsize=1)
def spaced() -> tuple[np.ndarray, np.ndarray]:
    """Words are runs without U+0020 and U+0009 to U+000D; A-Z in lower case."""
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return _classes(word)


@lru_cache(maxsize=1)
def alphanumeric() -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of ASCII letters and digits and of what is not ASCII; A-Z in lower case."""
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return _classes(word)


class Texts:
    """The bytes of some rows: data, and offsets with one more entry than there are rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of whole rows of up to `most` bytes, or one longer row."""
    data, offsets = view(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a row's first byte starts a new one."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = member[1:] != member[:-1]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = change | first[1:n]
    at = np.flatnonzero(edge)
    keep = member[at[:-1]]
    return at[:-1][keep], at[1:][keep]


def hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    total = int(lengths.sum())
    place = np.arange(total, dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    place -= np.repeat(heads, lengths)
    where = np.repeat(starts, lengths) + place
    with np.errstate(over="ignore"):
        x = _table()[((place & 63) << 8) | lower[where]]
        if lengths.max() > 64:
            x = x * ((place >> 6).astype(_U) * _U(2) + _U(1))
        return mix(np.add.reduceat(x, heads) + lengths.astype(_U))


class Words:
    """Words of the rows of a slice: hash, row, and where they start and end in the data."""

    def __init__(self, texts: Texts, classes: tuple[np.ndarray, np.ndarray]):
        word, lower = classes
        self.n = texts.n
        self.starts, self.ends = runs(word[texts.data], texts.offsets)
        self.lower = lower[texts.data]
        self.hash = hashes(self.lower, self.starts, self.ends)
        self.row = np.searchsorted(texts.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=texts.n)
        self.heads = np.cumsum(self.counts) - self.counts


def windows(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of `size` words of a row; with `short`, of a row with fewer words, but
    not none, all its words."""
    with np.errstate(over="ignore"):
        h = words.hash
        n = len(h)
        if n >= size:
            x = np.zeros(n - size + 1, _U)
            for k in range(size):
                x = x * _U(0xD6E8FEB86659FD93) + h[k : n - size + 1 + k]
            whole = words.row[: n - size + 1] == words.row[size - 1 :]
            first = np.flatnonzero(whole)
            x, row = mix(x[first] + _U(size)), words.row[first]
        else:
            x, row, first = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        few = np.flatnonzero((words.counts < size) & (words.counts > 0)) if short else np.zeros(0, np.int64)
        if not len(few):
            return x, row, first
        y = np.zeros(len(few), _U)
        for k in range(size - 1):
            on = words.counts[few] > k
            y[on] = y[on] * _U(0xD6E8FEB86659FD93) + h[words.heads[few[on]] + k]
        y = mix(y + words.counts[few].astype(_U))
        x, row, first = np.concatenate([x, y]), np.concatenate([row, few]), np.concatenate([first, words.heads[few]])
        order = np.argsort(row, kind="stable")
        return x[order], row[order], first[order]


def strings(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow array of the byte strings that follow each other in data."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
