"""What a corpus speaks of: counts of terms, pairs and triples of neighbouring terms.

A task counts its own texts in one table and hands it on whenever it has grown to MOST entries, so that what is shuffled
is each task's distinct terms, and memory is bounded whatever a task reads.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, TERM

MOST = 500_000


def counted(docs: DataFrame, sizes: tuple[int, ...], text_col: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """(term, n) of the given numbers of neighbouring terms, in lower case. One alone has three characters or more, not one
    character again and again, and is no stop word; of several the first and last are no stop words and have two
    characters or more. Null texts have none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, stop, counts = re.compile(TERM).findall, frozenset(stop_words), Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                terms = [t.lower() for t in find(text.as_py() or "")]
                if 1 in sizes:
                    counts.update(t for t in terms if len(t) >= 3 and t not in stop and t != t[0] * len(t))
                fit = [len(t) >= 2 and t not in stop for t in terms]
                for n in sizes:
                    if n > 1:
                        counts.update(" ".join(terms[i : i + n]) for i in range(len(terms) - n + 1) if fit[i] and fit[i + n - 1])
                if len(counts) >= MOST:
                    yield made()
        if counts:
            yield made()

    return docs.select(text_col).mapInArrow(each, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
