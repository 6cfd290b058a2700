"""Language identification: a linear-chain conditional random field over the words of a text.

A word's emission is a sum of hashed weights: the word itself, its affixes of 2 to 4 bytes, its 3-byte grams, and a
lexicon weight for each language (how much more often the word stands in that language's sample). Learned transitions
join neighbouring words, so that code-switched text is labelled word by word by forward-backward; a text's language is
the one with the largest sum of posterior marginals, each word weighed by its bytes, and its score is that share.

The field is fitted on a bounded sample of labelled rows, which the driver holds: up to SAMPLE_ROWS rows and SAMPLE_BYTES
bytes of each language, the first by a hash of id and text; of a text of more than EXCERPT characters an excerpt of so
many, from a place by that hash, so that each language with a labelled text is learned. To learn transitions, spans of
different sampled texts are put one after another. Everything else reads all rows. A label is never an input of a prediction.

Texts that are null, or have no letter, get `und` with score 0; so does every text where no labelled row could be
learned from. Null labels aren't learned from. Repeated rows are labelled alike. With one language there is no choice
to make, and it is predicted with score 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import Texts, Words, mix, slices, spaced
from lodestone.llm.tasks import by_slice

#: Labelled rows that the field is fitted on, for each language, and bytes of text that it takes from each.
SAMPLE_ROWS = 300
SAMPLE_BYTES = 500_000
#: Characters that a sampled text gives at most.
EXCERPT = 30_000
BUCKETS = 1 << 17
#: Words of a stretch that is handled at once; stretches of a text are joined by products of transfer matrices.
STRETCH = 48
#: Words of the spans that training puts one after another.
SPAN = (15, 60)
EPOCHS = 15
UNDETERMINED = "und"
_U = np.uint64


def features(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word after another, and how many each has."""
    n = ends - starts
    padded = np.concatenate([lower, np.zeros(4, np.uint8)]).astype(_U)
    words = np.arange(len(starts))
    flat, owner = [(hashes ^ _U(0x51)) % _U(BUCKETS)], [words]
    with np.errstate(over="ignore"):
        for size in (2, 3, 4):
            of = np.flatnonzero(n >= size)
            for kind, at in ((0, starts[of]), (1, ends[of] - size)):
                x = np.full(len(of), size * 2 + kind, _U)
                for k in range(size):
                    x = x * _U(257) + padded[at + k]
                flat.append(mix(x) % _U(BUCKETS))
                owner.append(of)
        of = np.flatnonzero(n >= 3)
        count = n[of] - 2
        where = np.repeat(starts[of] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        x = (padded[where] << _U(16)) | (padded[where + 1] << _U(8)) | padded[where + 2]
        flat.append(mix(x) % _U(BUCKETS))
        owner.append(np.repeat(of, count))
    flat, owner = np.concatenate(flat).astype(np.int64), np.concatenate(owner)
    at = np.argsort(owner, kind="stable")
    return flat[at], np.bincount(owner, minlength=len(starts))


class Field:
    """Weights, transitions and lexicon of the languages."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.change = np.where(np.eye(k, dtype=bool), 2.0, -2.0)
        self.words = np.zeros(0, _U)
        self.lexicon = np.zeros((0, k), np.float32)

    def emissions(self, lower, starts, ends, hashes) -> np.ndarray:
        """Scores of words by language."""
        if not len(starts):
            return np.zeros((0, len(self.langs)))
        flat, n = features(lower, starts, ends, hashes)
        out = np.add.reduceat(self.weights[flat], np.cumsum(n) - n).astype(np.float64)
        if len(self.words):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            known = self.words[at] == hashes
            out[known] += self.lexicon[at[known]]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray, pairs: bool = False):
    """Posterior marginals of every word of the chains of given lengths; with `pairs`, also the expected numbers of
    transitions and the log of all chains' normalisers."""
    n, k = scores.shape
    top = scores.max(1, keepdims=True)
    e = np.exp(scores - top)
    shift = change.max()
    t = np.exp(change - shift)
    lengths = lengths[lengths > 0]
    per = -(-lengths // STRETCH)
    heads = np.cumsum(lengths) - lengths
    first = np.cumsum(per) - per  # first stretch of each chain
    which = np.arange(int(per.sum())) - np.repeat(first, per)
    start = np.repeat(heads, per) + which * STRETCH
    size = np.minimum(STRETCH, np.repeat(heads + lengths, per) - start)
    # transfer matrices of the stretches
    m = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    longest = int(size.max()) if len(size) else 0
    for j in range(longest):
        on = np.flatnonzero(size > j) if j >= size.min() else slice(None)
        x = (m[on] @ t) * e[start[on] + j][:, None, :]
        m[on] = x / x.max((1, 2), keepdims=True)
    into = np.full((len(start), k), 1.0 / k)
    outof = np.full((len(start), k), 1.0 / k)
    most = int(per.max()) if len(per) else 0
    for j in range(1, most):
        at = first[per > j] + j
        x = np.einsum("ni,nij->nj", into[at - 1], m[at - 1])
        into[at] = x / x.sum(1, keepdims=True)
    for j in range(most - 2, -1, -1):
        at = first[per > j + 1] + j
        x = np.einsum("nij,nj->ni", m[at + 1], outof[at + 1])
        outof[at] = x / x.sum(1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    norm = np.zeros(n)
    a = into
    for j in range(longest):
        on = np.flatnonzero(size > j)
        x = (a[on] @ t) * e[start[on] + j]
        s = x.sum(1)
        norm[start[on] + j] = s
        a = a.copy()
        a[on] = x / s[:, None]
        alpha[start[on] + j] = a[on]
    b = outof
    for j in range(longest - 1, -1, -1):
        on = np.flatnonzero(size > j)
        beta[start[on] + j] = b[on]
        x = (e[start[on] + j] * b[on]) @ t.T
        b = b.copy()
        b[on] = x / x.sum(1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    if not pairs:
        return marginal
    before = np.empty((n, k))
    before[1:] = alpha[:-1]
    before[heads] = 1.0 / k
    inner = np.ones(n, bool)
    inner[heads] = False
    joint = before[inner][:, :, None] * t * (e * beta)[inner][:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return marginal, joint.sum(0), float(np.log(norm).sum() + top.sum() + shift * n)


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Field:
    """A field learned from whole texts with their languages."""
    langs = sorted(set(labels))
    field = Field(langs)
    if len(langs) < 2:
        return field
    k = len(langs)
    number = {x: i for i, x in enumerate(langs)}
    column = pa.array(texts, pa.string())
    parts = list(slices(column, sum(len(x.encode()) for x in texts) + 1))
    if not parts:
        return field
    words = Words(parts[0], spaced())
    gold = np.array([number[x] for x in labels])[words.row]
    # spans of different texts, one after another
    random = np.random.default_rng(seed)
    order, lengths = [], []
    spans = []
    for head, count in zip(words.heads.tolist(), words.counts.tolist()):
        while count > 0:
            take = min(count, int(random.integers(*SPAN)))
            spans.append((head, take))
            head, count = head + take, count - take
    random.shuffle(spans)
    for i in range(0, len(spans), 4):
        chain = [np.arange(a, a + n) for a, n in spans[i : i + 4]]
        order += chain
        lengths.append(sum(map(len, chain)))
    order, lengths = np.concatenate(order), np.array(lengths)
    gold = gold[order]
    distinct, one, which = np.unique(words.hash[order], return_index=True, return_inverse=True)
    one = order[one]
    flat, n = features(words.lower, words.starts[one], words.ends[one], distinct)
    owner = np.repeat(np.arange(len(distinct)), n)
    counts = np.stack([np.bincount(which[gold == i], minlength=len(distinct)) for i in range(k)], axis=1).astype(float)
    share = (counts + 0.2) / (counts.sum(0) + 0.2 * len(distinct))
    often = counts.sum(1) >= 3
    lexicon = 0.5 * (np.log(share) - np.log(share).mean(1, keepdims=True)) * often[:, None]
    field.words, field.lexicon = distinct[often], lexicon[often].astype(np.float32)
    weights, squares = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1.0)
    change, change_squares = field.change.copy(), np.full((k, k), 1.0)
    inner = np.ones(len(order), bool)
    inner[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    for _ in range(epochs):
        scores = np.stack([np.bincount(owner, weights=weights[flat, i], minlength=len(distinct)) for i in range(k)], axis=1) + lexicon
        marginal, joint, _ = forward_backward(scores[which], lengths, change, pairs=True)
        expected = np.stack([np.bincount(which, weights=marginal[:, i], minlength=len(distinct)) for i in range(k)], axis=1)
        by_word = counts - expected
        gradient = np.stack([np.bincount(flat, weights=by_word[owner, i], minlength=BUCKETS) for i in range(k)], axis=1) - 0.05 * weights
        squares += gradient**2
        weights += 0.25 * gradient / np.sqrt(squares)
        step = seen - joint
        change_squares += step**2
        change += 0.25 * step / np.sqrt(change_squares)
    field.weights, field.change = weights.astype(np.float32), change
    return field


def _sampled(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> list:
    """(lang, text) of the sample. Rows are narrowed by the hash before they are ordered, so that no task orders all. Rows that
    repeat an id and text are one: a language is narrowed by the number of its different rows."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    share = F.col("key").bitwiseAND(F.lit(0xFFFFF)) / F.lit(float(1 << 20))
    counts = known.select("lang", "key").distinct().groupBy("lang").count()
    small = F.broadcast(counts)  # one row a language
    start = F.pmod(F.col("key"), F.length("text") - EXCERPT + 1).cast("int") + 1
    excerpt = F.when(F.length("text") > EXCERPT, F.substring("text", start, F.lit(EXCERPT))).otherwise(F.col("text"))
    thin = known.join(small, "lang").where(share < 3.0 * SAMPLE_ROWS / F.col("count")).dropDuplicates(["lang", "key"]).withColumn("text", excerpt)
    ranked = thin.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key", "text"))).where(F.col("rank") <= SAMPLE_ROWS)
    total = F.sum(F.octet_length("text")).over(W.partitionBy("lang").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return [(r.lang, r.text) for r in ranked.withColumn("total", total).where(F.col("total") <= SAMPLE_BYTES).select("lang", "text").orderBy("lang", "text").collect()]


def _has_letter(texts: Texts) -> np.ndarray:
    """Whether each row holds a letter."""
    data = texts.data
    ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    rows = np.zeros(texts.n, bool)
    rows[np.unique(np.searchsorted(texts.offsets, np.flatnonzero(ascii_letter), "right") - 1)] = True
    for row in np.flatnonzero(~rows):
        rows[row] = any(map(str.isalpha, texts.bytes(row).decode("utf-8", "replace")))
    return rows


def label(field: Field, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Number of the predicted language (-1: none) and score of each row."""
    best, score = np.full(texts.n, -1), np.zeros(texts.n)
    letter = _has_letter(texts)
    if not field.langs:
        return best, score
    if len(field.langs) == 1:
        return np.where(letter, 0, -1), letter.astype(float)
    words = Words(texts, spaced())
    distinct, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
    scores = field.emissions(words.lower, words.starts[one], words.ends[one], distinct)
    if not len(distinct):
        return best, score
    marginal = forward_backward(scores[which], words.counts, field.change)
    size = (words.ends - words.starts).astype(float)
    sums = np.stack([np.bincount(words.row, weights=size * marginal[:, i], minlength=texts.n) for i in range(len(field.langs))], axis=1)
    total = np.maximum(sums.sum(1), 1e-300)
    best = np.where(letter, sums.argmax(1), -1)
    return best, np.where(letter, np.clip(sums.max(1) / total, 0, 1), 0.0)


def _fitted(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str):
    found = _sampled(docs, learn, id_col, text_col, lang_col)
    return docs.sparkSession.sparkContext.broadcast(fit([t for _, t in found], [x for x, _ in found]))


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the id, lang_pred and score. learn: which rows may be learned from."""
    field = _fitted(docs, learn, id_col, text_col, lang_col)
    docs = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        best, score = label(field.value, texts)
        names = [*field.value.langs, UNDETERMINED]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score)], names=schema.names)

    return by_slice(docs, schema, work, text_col)


def identified(docs: DataFrame, learn: Column, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with all their columns, whose language is determined with a score of `least` or more."""
    field = _fitted(docs, learn, id_col, text_col, lang_col)

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        best, score = label(field.value, texts)
        return rows.filter(pa.array((best >= 0) & (score >= least)))

    return by_slice(docs, docs.schema, work, text_col)
