"""Token counts: exact numbers of tokens of prefixes, for truncation and budget questions.

A text's prefix counts are built by dynamic programming over its units (runs of letters, single digits, marks; see
`bpe`): count(end of unit i) = count(end of unit i - 1) + tokens of unit i, for no token reaches across units. A prefix
that ends inside a unit has the count at the unit's start and that of the unit's own prefix. Budget questions are then
searches in the table; of a text over the budget only the unit where it ends is encoded again, pre-token by pre-token.

Null and empty texts have no bytes and no tokens. Rows that repeat are answered each. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.bpe import WordBpe, word_bpe
from lodestone.llm.bytesio import Texts
from lodestone.llm.tasks import by_slice


#: Prefixes of a pre-token that are tried at once.
TRIED = 16


def _pieces(found, length: int) -> list[tuple[int, int, int]]:
    """Starts, ends and tokens of an encoding's pre-tokens. A special token is one with the pre-token before it, to which
    the marks of its own prefixes would belong."""
    out: list[list[int]] = []
    before = None
    for word, (start, _), special in zip(found.word_ids, found.offsets, [x.startswith("<|") and x.endswith("|>") for x in found.tokens]):
        if out and (special or word is not None and word == before):
            out[-1][1] += 1
        else:
            out.append([start, 1])
        before = None if special else word
    ends = [start for start, _ in out[1:]] + [length]
    return [(start if k else 0, end, n) for k, ((start, n), end) in enumerate(zip(out, ends))]


class PrefixCounts:
    """Counts at the unit ends of one slice, for all its rows."""

    def __init__(self, bpe: WordBpe, texts: Texts):
        self.bpe, self.texts = bpe, texts
        self.starts, self.ends, n = bpe.counts(texts)
        self.total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=self.total[1:])
        #: The first unit of each row, and one more.
        self.first = np.searchsorted(self.starts, texts.offsets, "left")

    def whole(self) -> np.ndarray:
        """Tokens of each row."""
        return self.total[self.first[1:]] - self.total[self.first[:-1]]

    def _word(self, unit: int) -> str:
        return self.texts.data[self.starts[unit] : self.ends[unit]].tobytes().decode()

    def _tokens(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.bpe.library.encode_batch_fast(texts, add_special_tokens=False)]

    def inside(self, unit: int, room: int) -> int:
        """Characters of the longest prefix of a unit of up to `room` tokens. The count runs on over the library's own
        pre-tokens; prefixes are tried only inside the one where room ends."""
        word = self._word(unit)
        for start, end, n in _pieces(self.bpe.library.encode(word, add_special_tokens=False), len(word)):
            if n > room:
                return start + self._within(word[start:end], room)
            room -= n
        return len(word)

    def _within(self, piece: str, room: int) -> int:
        """The same within a pre-token: from the longest prefix that so many tokens can cover down, a few at a time."""
        most = self.bpe.reach(piece, room)
        for a in range(most, 0, -TRIED):
            sizes = range(a, max(0, a - TRIED), -1)
            for k, n in zip(sizes, self._tokens([piece[:k] for k in sizes])):
                if n <= room:
                    return k
        return 0

    def at(self, row: int, size: int) -> int:
        """Tokens of a row's first `size` bytes."""
        to = self.texts.offsets[row] + size
        unit = int(np.searchsorted(self.ends, to, "right"))
        count = int(self.total[unit] - self.total[self.first[row]])
        if unit < len(self.starts) and self.starts[unit] < to:
            count += self._tokens([self.texts.data[self.starts[unit] : to].tobytes().decode()])[0]
        return count

    def fitting(self, budget: int) -> np.ndarray:
        """Bytes of each row's longest prefix of up to `budget` tokens."""
        out = np.diff(self.texts.offsets).copy()
        for row in np.flatnonzero(self.whole() > budget):
            base = self.total[self.first[row]]
            unit = int(np.searchsorted(self.total, base + budget, "right")) - 1  # the first that doesn't fit whole
            room = base + budget - self.total[unit]
            inside = self._word(unit)[: self.inside(unit, int(room))]
            out[row] = self.starts[unit] + len(inside.encode()) - self.texts.offsets[row]
        return out


def token_counts(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit (more than budget tokens) and fitting_bytes, the bytes of the
    longest prefix within the budget."""
    docs = docs.select(id_col, text_col)
    schema = T.StructType(
        [docs.schema[id_col], *(T.StructField(c, t) for c, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("fitting_bytes", T.LongType())))]
    )

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        counts = PrefixCounts(word_bpe(vocabulary), texts)
        n = counts.whole()
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(texts.offsets)), pa.array(n), pa.array(n > budget), pa.array(counts.fitting(budget))],
            names=schema.names,
        )

    return by_slice(docs, schema, work, text_col)


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and its prefix table, as two arrays of equal length: ends (bytes) and counts (tokens up to there)."""
    docs = docs.select(id_col, text_col)
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([docs.schema[id_col], T.StructField("ends", longs), T.StructField("counts", longs)])

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        c = PrefixCounts(word_bpe(vocabulary), texts)
        units = np.diff(c.first)
        ends = c.ends - np.repeat(texts.offsets[:-1], units)
        counts = c.total[1:] - np.repeat(c.total[c.first[:-1]], units)
        heads = pa.array(c.first.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [rows.column(0), *(pa.ListArray.from_arrays(heads, pa.array(x)) for x in (ends, counts))], names=schema.names
        )

    return by_slice(docs, schema, work, text_col)
