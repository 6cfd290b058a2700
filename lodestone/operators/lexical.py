"""The lexical index as tables, and Okapi BM25 over it.

postings(topic, doc_id, term, tf, dl) and term_stats(topic, term, df, idf) are plain aggregates; a search is a join on
(topic, term) and a sum. Inverse document frequencies are those of a document's own topic. An index of a table of files is
written once to the shared folder and found there by later queries; searches read it and no text. Postings are kept as one
row a document, so that a task has all terms of its documents: it sums their scores and hands on the best alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import STOP_WORDS, TOKEN, tokens
from lodestone.sources.shared import exists, folder, renamed, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Most terms of a set of queries, each counted for each query and topic, that are sent to all tasks; beyond these they and
#: the postings are shuffled by term. As many pairs of a query and a topic may there be.
ASKED = 400_000


#: Postings that a task hands on at once, and scores that it adds up at once.
BATCH = 200_000
CELLS = 1 << 20

#: Bytes of a token, "." and "-" included; all others are spaces.
_BYTES = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789.-" else 32 for i in range(256))
#: Stop words and single characters.
_STOP = frozenset([*STOP_WORDS, *map(chr, range(128))])


def counter() -> Callable[[str], Counter]:
    """A function that counts a text's tokens as findall of TOKEN over its lower-case form has them, without stop words and
    single characters. Made where it is used, so that tasks need no module of this package."""
    find = re.compile(TOKEN).findall

    def counted(text: str) -> Counter:
        counts = Counter(text.lower().encode("utf-8", "replace").translate(_BYTES).replace(b". ", b"  ").decode("ascii").split())
        for word in [w for w in counts if "." in w or "-" in w]:
            n = counts.pop(word)
            for token in find(word):
                counts[token] += n
        for word in _STOP.intersection(counts):
            del counts[word]
        return counts

    return counted


def packed(docs: DataFrame, topic: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with tokens: their terms, counts (tfs) and length (dl). A document is one row, so its terms are counted
    where it is read: no text is shuffled."""
    rows = docs.select(topic.alias("topic"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = (("dl", T.IntegerType()), ("terms", T.ArrayType(T.StringType())), ("tfs", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(c, t) for c, t in fields)])
    counted = counter()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, dls, starts, terms, tfs = [], [], [0], [], []

            def made(batch=batch) -> pa.RecordBatch:
                at, cuts = pa.array(of, pa.int64()), pa.array(starts, pa.int32())  # noqa: B023
                lists = (pa.ListArray.from_arrays(cuts, pa.array(x, kind)) for x, kind in ((terms, pa.string()), (tfs, pa.int32())))  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dls, pa.int32()), *lists], names=schema.names)  # noqa: B023

            for i, text in enumerate(batch.column(2)):
                if own := counted(text.as_py() or ""):
                    of.append(i)
                    dls.append(sum(own.values()))
                    terms += own
                    tfs += own.values()
                    starts.append(len(terms))
                if len(terms) >= BATCH:
                    yield made()
                    of, dls, starts, terms, tfs = [], [], [0], [], []
            if of:
                yield made()

    return rows.mapInArrow(each, schema)


def flat(posted: DataFrame) -> DataFrame:
    """Packed postings as one row a document and term."""
    pairs = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("p")
    return posted.select("topic", "doc_id", "dl", pairs).select("topic", "doc_id", "p.term", F.col("p.tf").cast("long").alias("tf"), "dl")


def postings(docs: DataFrame, topic: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Terms of documents with their counts (tf) and the document's length (dl)."""
    return flat(packed(docs, topic, id_col, text_col))


def index(docs: DataFrame, topic: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Packed postings, and term statistics over them; what both need of the texts is written once, to `path` if given."""
    posted = written(packed(docs, topic, id_col, text_col), path)
    return posted, _stats(posted, docs, topic)


def _stats(posted: DataFrame, docs: DataFrame, topic: Column) -> DataFrame:
    terms = written(posted.select("topic", F.explode("terms").alias("term")).groupBy("topic", "term").agg(F.count("*").alias("df")))
    # documents without tokens have no postings, but count
    n = docs.groupBy(topic.alias("topic")).agg(F.count("*").alias("n"))
    held = posted.groupBy("topic").agg(F.sum(F.col("dl").cast("long")).alias("held"))
    topics = n.join(held, "topic", "left").select("topic", "n", (F.coalesce("held", F.lit(0)) / F.col("n")).alias("avgdl"))
    return _weighed(terms, topics)


def opened(docs: DataFrame, topic: Column, name: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of a table of files, built by the first that asks for it and read by all after. It is kept in the shared
    folder under a key of the files' paths, sizes and times, the columns, `name` (which stands for the topic) and the
    tokenizer; changed files have another key. It appears whole or not at all: it is written aside and then renamed."""
    spark = docs.sparkSession
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = docs.select(file.alias("file")).groupBy("file").agg(F.count("*").alias("n")).agg(F.count("*").alias("files"), F.sum(F.xxhash64("file").cast("decimal(38,0)")).alias("hash"), F.sum("n").alias("n")).first()
    key = hashlib.md5(repr(("packed", files.files, str(files.hash), files.n, name, id_col, text_col, TOKEN, STOP_WORDS, EPSILON)).encode()).hexdigest()
    path = f"{folder(spark)}/lodestone-lexical-{key}"
    if not exists(spark, path):
        aside = f"{path}-{uuid.uuid4().hex}"
        _, stats = index(docs, topic, id_col, text_col, f"{aside}/postings")
        stats.write.option("compression", "zstd").parquet(f"{aside}/stats")
        renamed(spark, aside, path)
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def stored(docs: DataFrame, topic: Column, name: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What `opened` has, with one row a document and term."""
    posted, stats = opened(docs, topic, name, id_col, text_col)
    return flat(posted), stats


def topic_stats(docs: DataFrame, topic: Column, text_col: str = "text") -> DataFrame:
    """Documents and their mean length, by topic; documents without tokens count."""
    return docs.groupBy(topic.alias("topic")).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("avgdl"))


def term_stats(posted: DataFrame, topics: DataFrame) -> DataFrame:
    """df and idf of each topic's terms; an idf below 0 becomes EPSILON times the topic's mean idf."""
    return _weighed(posted.groupBy("topic", "term").agg(F.count("*").alias("df")), topics)


def _weighed(df: DataFrame, topics: DataFrame) -> DataFrame:
    raw = df.join(topics, "topic").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("topic").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(mean, "topic").select("topic", "term", "df", idf.alias("idf"), "avgdl")


def search(queries: DataFrame, posted: DataFrame, stats: DataFrame, k: int, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query in each topic, by positive score, ties to the lesser id. A query's repeated
    tokens count again. posted: packed. What the queries ask for, with its weights in each topic, goes to all tasks where it
    has few rows (counted first) and each document is one row of a whole number; else it meets the postings in a join."""
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.join(stats, "term").select("query_id", "topic", "term", (F.col("idf") * F.col("times") * (K1 + 1)).alias("w"), "avgdl")
    best = W.partitionBy("query_id", "topic").orderBy(F.desc("score"), "doc_id")
    scored = _summed(posted, wanted, k)
    if scored is None:
        score = F.col("w") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = flat(posted).join(wanted, ["topic", "term"]).groupBy("query_id", "topic", "doc_id").agg(F.sum(score).alias("score"))
    scored = scored.withColumn("score", F.round("score", 6)).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _summed(posted: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """Scores of documents by query and topic, of which each task leaves out those that k of its own surpass. None where
    a task can't have all that it needs."""
    if not isinstance(posted.schema["doc_id"].dataType, (T.LongType, T.IntegerType)):
        return None
    if posted.groupBy("topic", "doc_id").count().where("count > 1").limit(1).count():
        return None
    few = wanted.where("topic is not null and query_id is not null").limit(ASKED + 1).toArrow()
    coded = lambda c: pc.dictionary_encode(c.combine_chunks())
    query, topic, term = (coded(few.column(c)) for c in ("query_id", "topic", "term"))
    if few.num_rows > ASKED or len(query.dictionary) * len(topic.dictionary) > ASKED:
        return None
    n_queries, n_terms = max(1, len(query.dictionary)), max(1, len(term.dictionary))
    at_query, at_topic, at_term = (x.indices.to_numpy().astype(np.int64) for x in (query, topic, term))
    weights, means = few.column("w").to_numpy(), np.zeros(len(topic.dictionary))
    means[at_topic] = few.column("avgdl").to_numpy()
    pair = at_topic * n_terms + at_term
    order = np.argsort(pair, kind="stable")
    pairs, first, n = np.unique(pair[order], return_index=True, return_counts=True)
    sent = posted.sparkSession.sparkContext.broadcast((query.dictionary, topic.dictionary, term.dictionary, means, pairs, first, n, at_query[order], weights[order]))
    kind = pa.int64() if isinstance(posted.schema["doc_id"].dataType, T.LongType) else pa.int32()
    schema = T.StructType([wanted.schema["query_id"], wanted.schema["topic"], posted.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with CELLS terms or so in all, however long they are."""
        for batch in batches:
            part = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)) // CELLS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, topics, terms, means, pairs, first, n, asks, weights = sent.value
        least = np.zeros(len(topics) * n_queries)  # the kth best score so far of each topic and query
        group, doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in parts(batches) if len(pairs) else ():
            own = pc.fill_null(pc.index_in(batch.column(0), value_set=topics), -1).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(own)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            some = np.flatnonzero((at >= 0) & (own[of] >= 0))
            of, key = of[some], own[of[some]].astype(np.int64) * n_terms + at[some]
            place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            met = pairs[place] == key
            of, place, tf = of[met], place[met], batch.column(4).flatten().to_numpy(zero_copy_only=False)[some][met]
            dl, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            share = tf / (tf + K1 * (1 - B + B * dl[of] / means[own[of]]))
            # documents in stretches of CELLS sums and scores at most, or of one document
            cost = np.bincount(of, n[place], len(own)) + n_queries
            stretch = np.cumsum(cost) // CELLS
            cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(own)]
            ends = np.searchsorted(of, cuts)
            for a, b, x, y in zip(cuts, cuts[1:], ends, ends[1:]):
                reps = n[place[x:y]]
                to = np.arange(reps.sum()) + np.repeat(first[place[x:y]] - np.cumsum(reps) + reps, reps)
                sums = np.bincount(np.repeat((of[x:y] - a) * n_queries, reps) + asks[to], weights[to] * np.repeat(share[x:y], reps), (b - a) * n_queries)
                cell = np.flatnonzero(sums > 0)
                row = a + cell // n_queries
                g = own[row].astype(np.int64) * n_queries + cell % n_queries
                good = np.round(sums[cell], 6) >= least[g]
                if not good.any():
                    continue
                group, doc, score = np.append(group, g[good]), np.append(doc, ids[row[good]]), np.append(score, sums[cell[good]])
                order = np.lexsort((doc, -np.round(score, 6), group))
                group, doc, score = group[order], doc[order], score[order]
                new = np.append(True, group[1:] != group[:-1])
                nth = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
                full = nth == k - 1
                least[group[full]] = np.round(score[full], 6)
                group, doc, score = (v[nth < k] for v in (group, doc, score))
        columns = [query_ids.take(pa.array(group % n_queries)), topics.take(pa.array(group // n_queries)), pa.array(doc, kind), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return posted.select("topic", "doc_id", "dl", "terms", "tfs").mapInArrow(each, schema)
