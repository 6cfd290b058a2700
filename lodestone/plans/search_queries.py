"""Queries of the retrieval operators: topic := language, questions := benchmark items, sources := documents.source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import scores, text
from lodestone.operators import lexical, profile, ranking, vectors
from lodestone.registry import query, table, words_list
from lodestone.sources.shared import written

STOP = words_list(text.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"
_BM25 = f"""
toks AS (SELECT lang AS topic, doc_id, {_TOKENS} AS ts FROM documents),
topics AS (SELECT topic, count(*) AS n, avg(len(ts)) AS avgdl FROM toks GROUP BY topic),
post AS (SELECT topic, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT topic, doc_id, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY topic, doc_id, term),
dfs AS (SELECT topic, term, count(*) AS df, any_value(n) AS n, any_value(avgdl) AS avgdl FROM post JOIN topics USING (topic) GROUP BY topic, term),
raw AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs),
means AS (SELECT topic, avg(r) AS m FROM raw GROUP BY topic),
stats AS (SELECT topic, term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf, avgdl FROM raw JOIN means USING (topic)),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY query_id, term),
scored AS (SELECT query_id, topic, doc_id, round(sum(times * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN stats USING (topic, term) JOIN asked USING (term) GROUP BY query_id, topic, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, topic ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def _index(spark: SparkSession, sf_dir: str):
    return lexical.opened(table(spark, sf_dir, "documents"), F.col("lang"), "lang")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.search(_questions(spark, sf_dir), *_index(spark, sf_dir), k)


def _with_documents(hits: DataFrame, spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Hits with these columns of their documents. Hits, a bounded list a question, are written first, so that Spark knows
    their size: few are sent to where the documents are read, and no text is shuffled to meet them."""
    return written(hits).join(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


@query(f"WITH {_BM25.strip()} SELECT topic, term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and inverse document frequencies of each topic's terms."""
    return _index(spark, sf_dir)[1].select("topic", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25.strip()} SELECT query_id, topic, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents of each question in each topic."""
    return _bm25(spark, sf_dir, 5).select("query_id", "topic", "doc_id", "score", "rank")


_NGRAM = "({a}) NOT IN (SELECT unnest({s})) AND length({a}) >= 2"
_TERMS = f"""t AS (SELECT list_transform(regexp_extract_all(text, '{text.TERM}'), lambda x: lower(x)) AS ts FROM documents),
u AS (SELECT unnest(ts) AS term FROM t),
g AS (SELECT ts, unnest(range(1, len(ts) + 1)) AS i FROM t)"""
_GOOD = f"NOT list_contains({STOP}, {{0}}) AND length({{0}}) >= 2"
_PROFILE = f"""WITH {_TERMS},
uni AS (SELECT term, count(*) AS n FROM u WHERE length(term) >= 3 AND len(list_distinct(string_split(term, ''))) > 1 AND NOT list_contains({STOP}, term) GROUP BY term),
bi AS (SELECT ts[i] || ' ' || ts[i + 1] AS term, count(*) AS n FROM g WHERE i + 1 <= len(ts) AND {_GOOD.format("ts[i]")} AND {_GOOD.format("ts[i + 1]")} GROUP BY 1),
tri AS (SELECT ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2] AS term, count(*) AS n FROM g WHERE i + 2 <= len(ts) AND {_GOOD.format("ts[i]")} AND {_GOOD.format("ts[i + 2]")} GROUP BY 1)"""


def _counted(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return profile.counted(table(spark, sf_dir, "documents"), (n,))


@query(f"{_PROFILE} SELECT term, n FROM uni WHERE n >= 2")
def corpus_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid terms that occur twice or more."""
    return _counted(spark, sf_dir, 1).where("n >= 2")


@query(f"{_PROFILE} SELECT term, n FROM bi WHERE n >= 2")
def corpus_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring terms without stop words."""
    return _counted(spark, sf_dir, 2).where("n >= 2")


@query(f"""{_PROFILE}, pool AS (SELECT term, n AS frequency FROM uni WHERE n >= 2 UNION ALL SELECT term, 2 * n FROM bi WHERE n >= 2 UNION ALL SELECT term, 3 * n FROM tri WHERE n >= 2)
SELECT term, frequency FROM pool ORDER BY frequency DESC, term LIMIT 100""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred top terms, pairs counting twice and triples three times."""
    # a term's kind is the number of its words
    rows = profile.counted(table(spark, sf_dir, "documents"), (1, 2, 3)).where("n >= 2")
    return rows.select("term", (F.col("n") * F.size(F.split("term", " "))).alias("frequency")).orderBy(F.desc("frequency"), "term").limit(100)


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_KNN = f"""
v AS (SELECT vec_id, embedding AS e, sqrt({_DOT.format(a="embedding", b="embedding")}) AS norm FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round({_DOT.format(a="q.e", b="v.e")} / (q.norm * v.norm), 6) + 0.0 AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims)"""


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(vectors.valid(rows, 64), vectors.valid(rows.where("vec_id % 50 = 0"), 64), k)


@query(f"WITH {_KNN.strip()} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine neighbours of a fiftieth of the vectors among all."""
    return _knn(spark, sf_dir, 10).select("query_id", "vec_id", "score", "rank")


@query(f"""WITH {_KNN.strip()}, top AS (SELECT * FROM near WHERE rank <= 10)
SELECT query_id, vec_id, score, round(CASE WHEN score >= 0.45 THEN least(0.98, 0.90 + (score - 0.45) * 0.4) WHEN score >= 0.35 THEN 0.80 + (score - 0.35) WHEN score >= 0.25 THEN 0.65 + (score - 0.25) * 1.5
 WHEN score >= 0.15 THEN 0.40 + (score - 0.15) * 2.5 WHEN score >= 0.10 THEN 0.25 + (score - 0.10) * 3.0 ELSE score * 2.5 END, 6) AS normalized FROM top""")
def score_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities on the display scale."""
    return _knn(spark, sf_dir, 10).select("query_id", "vec_id", "score", F.round(scores.normalized(F.col("score")), 6).alias("normalized"))


@query(f"""WITH {_KNN.strip()}, best AS (SELECT query_id, max(score) AS best FROM near WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, best, CASE WHEN best < 0.2 THEN 'low' WHEN best < 0.4 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN best >= 0.35 THEN 'high' WHEN best >= 0.25 THEN 'medium' ELSE 'low' END AS corrective FROM best""")
def confidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each query's best hit can be trusted, on both scales."""
    best = _knn(spark, sf_dir, 10).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", "best", scores.confidence(F.col("best")).alias("confidence"), scores.corrective_confidence(F.col("best")).alias("corrective"))


@query(f"""WITH {_KNN.strip()}, top AS (SELECT query_id, vec_id AS doc_id, score, rank AS n, max(score) OVER (PARTITION BY query_id) >= 0.36 AS has_any FROM near WHERE rank <= 10)
SELECT query_id, doc_id, score FROM top WHERE CASE WHEN has_any THEN score >= 0.36 ELSE n <= 3 END""")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits above a score, or the three best where none is."""
    rows = _knn(spark, sf_dir, 10).withColumnRenamed("vec_id", "doc_id")
    return ranking.gated(rows, "score", 0.36, 3).select("query_id", "doc_id", "score")


_LISTS = f"""{_BM25.strip()}, {_KNN.strip()},
sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ranked WHERE rank <= 20),
dense AS (SELECT (SELECT min(item_id) FROM benchmark) + query_id // 50 AS query_id, vec_id AS doc_id, score, rank FROM near WHERE rank <= 20),
parts AS (SELECT query_id, doc_id, 0 AS pos, 0.7 / (60 + rank) AS share, score FROM dense UNION ALL SELECT query_id, doc_id, 1, 0.3 / (60 + rank), score FROM sparse WHERE rank <= 20),
fused AS (SELECT query_id, doc_id, round(sum(share), 8) AS rrf_score, arg_min(score, pos) AS score, count(*) AS n_lists FROM parts GROUP BY query_id, doc_id)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical lists of a question; by convention the vector of number 50 n stands for the nth question and a
    vector's id names a document."""
    first = table(spark, sf_dir, "benchmark").agg(F.min("item_id")).first()[0]
    dense = _knn(spark, sf_dir, 20).select((F.floor(F.col("query_id") / 50) + first).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    sparse = _bm25(spark, sf_dir, 20).select("query_id", "doc_id", "score", F.row_number().over(best).alias("rank")).where("rank <= 20")
    weights = ranking.fusion_weights()
    return ranking.fused({"dense": (dense, weights["dense"]), "sparse": (sparse, weights["sparse"])})


@query(f"WITH {_LISTS} SELECT query_id, doc_id, rrf_score, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of dense and lexical lists."""
    return _fused(spark, sf_dir).select("query_id", "doc_id", "rrf_score", "n_lists", "rank")


_WORDS = ["the", "and", "tion", "ment"]


@query(f"""WITH {_LISTS}, rows AS (SELECT f.query_id, f.doc_id, rrf_score, d.text AS body, b.text AS q FROM fused f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id)
SELECT query_id, doc_id, round(rrf_score + CASE WHEN len(list_filter({words_list(_WORDS)}, lambda w: contains(lower(q), w))) > 0 THEN least(len(list_filter({words_list(_WORDS)}, lambda w: contains(lower(body), w))), 3) / 3 * 0.1 ELSE 0.0 END, 6) AS boosted FROM rows""")
def domain_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lift for hits with words of the domain, for questions that have some."""
    asked = _questions(spark, sf_dir).withColumnRenamed("text", "q")
    rows = _with_documents(_fused(spark, sf_dir), spark, sf_dir, "text").withColumnRenamed("text", "body").join(asked, "query_id")
    return ranking.boosted(rows, "rrf_score", F.col("body"), F.col("q"), _WORDS).select("query_id", "doc_id", "boosted")


@query(f"""WITH {_LISTS}, pair AS (SELECT query_id, doc_id, coalesce(a.score, 0.0) AS x, coalesce(b.score, 0.0) AS y FROM (SELECT * FROM dense WHERE rank <= 10) a FULL OUTER JOIN (SELECT * FROM dense WHERE rank > 5) b USING (query_id, doc_id))
SELECT query_id, doc_id, round(x * 0.7 + y * 0.3, 7) AS score FROM pair""")
def summary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of direct and summary hits (ranks 1 to 10, and 6 to 20, of the dense list stand for them)."""
    first = table(spark, sf_dir, "benchmark").agg(F.min("item_id")).first()[0]
    dense = _knn(spark, sf_dir, 20).select((F.floor(F.col("query_id") / 50) + first).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    return ranking.merged_summary(dense.where("rank <= 10"), dense.where("rank > 5"))


_WORD_SET = "list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> ''))"
_ALIKE = "CASE WHEN len(t.w) = 0 OR len(c.w) = 0 THEN 0.0 ELSE len(list_intersect(t.w, c.w)) / (len(t.w) + len(c.w) - len(list_intersect(t.w, c.w))) END"


@query(f"""WITH RECURSIVE {_BM25.strip()}, best AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM ranked WHERE rank <= 15),
cand AS (SELECT b.query_id, b.doc_id, n, d.source, {_WORD_SET} AS w, (b.score - min(b.score) OVER q) / CASE WHEN max(b.score) OVER q > min(b.score) OVER q THEN max(b.score) OVER q - min(b.score) OVER q ELSE 1 END AS rel FROM best b JOIN documents d USING (doc_id) WHERE n <= 15 WINDOW q AS (PARTITION BY b.query_id)),
r AS (SELECT query_id, 0 AS pick, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS DOUBLE) AS v, CAST([] AS STRUCT(d BIGINT, s VARCHAR, w VARCHAR[])[]) AS taken FROM cand GROUP BY query_id UNION ALL
 SELECT query_id, pick + 1, doc_id, v, list_append(taken, {{'d': doc_id, 's': source, 'w': w}}) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, n) AS k FROM (
  SELECT c.query_id, c.doc_id, c.n, c.source, c.w, r.pick, r.taken, 0.6 * rel - 0.4 * greatest(0.0, coalesce(list_max(list_transform(r.taken, lambda t: {_ALIKE})), 0.0)) AS v FROM r JOIN cand c ON c.query_id = r.query_id
  WHERE r.pick < 5 AND len(list_filter(r.taken, lambda t: t.d = c.doc_id)) = 0 AND len(list_filter(r.taken, lambda t: t.s = c.source)) < 2)) WHERE k = 1)
SELECT query_id, doc_id, pick, round(v, 6) AS mmr_score FROM r WHERE pick > 0""")
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five picks of each question's fifteen best, relevant and unlike each other, two a source."""
    best = _bm25(spark, sf_dir, 15).select("query_id", "doc_id", "score", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).alias("n")).where("n <= 15")
    rows = _with_documents(best, spark, sf_dir, "source", "text").select("query_id", "doc_id", "score", "source", text.word_set(F.col("text")).alias("words"))
    return ranking.diverse(rows, 5)


@query(f"""WITH {_BM25.strip()}, hits AS (SELECT r.query_id, r.topic, r.rank, r.doc_id, d.source, d.text FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 5),
refs AS (SELECT *, row_number() OVER (PARTITION BY query_id, topic, source ORDER BY rank) AS n FROM hits)
SELECT query_id, topic, string_agg('--- [' || source || '] ---' || chr(10) || substr(text, 1, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS context,
 string_agg(CASE WHEN n = 1 THEN rank || ':' || source END, ',' ORDER BY rank) AS refs FROM refs GROUP BY query_id, topic""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that answers are made from, and its references, each source once."""
    hits = _with_documents(_bm25(spark, sf_dir, 5), spark, sf_dir, "source", "text")
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("query_id", "topic", "source").orderBy("rank")))
    body = F.concat(F.lit("--- ["), F.col("source"), F.lit("] ---\n"), F.substring("text", 1, 500), F.when(F.length("text") > 500, "...").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("rank", body.alias("body"), F.when(F.col("n") == 1, F.concat_ws(":", "rank", "source")).alias("ref"))))
    out = hits.groupBy("query_id", "topic").agg(ordered.alias("rows"))
    refs = F.transform(F.filter("rows", lambda r: r["ref"].isNotNull()), lambda r: r["ref"])
    return out.select("query_id", "topic", F.array_join("rows.body", "\n\n").alias("context"), F.array_join(refs, ",").alias("refs"))


@query("""WITH w AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS ws FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.ws, b.ws)) AS n_both, len(a.ws) AS x, len(b.ws) AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang)
SELECT a, b, round(CASE WHEN x = 0 OR y = 0 THEN 0.0 ELSE n_both / (x + y - n_both) END, 6) AS jaccard FROM p""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-set similarity of all neighbouring documents of a language, however long."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", text.word_set(F.col("text")).alias("ws"))
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("ws").alias("other"), F.col("doc_id").alias("b"))
    return rows.join(other, ["doc_id", "lang"]).select(F.col("doc_id").alias("a"), "b", F.round(text.jaccard(F.col("ws"), F.col("other")), 6).alias("jaccard"))


@query(r"""WITH m AS (SELECT page_id, lower(url) AS url, rtrim(split_part(lower(url), '?', 1), '/') AS key FROM pages)
SELECT page_id, key, quality, round(quality + 0.5 * (n - 1), 6) AS score FROM (SELECT page_id, key, CASE WHEN contains(url, 'example.org') THEN 2 WHEN contains(url, 'blog.') THEN 1 ELSE 0 END AS quality,
 count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY page_id) AS k FROM m) WHERE k = 1""", score="DOUBLE")
def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses once each, with their quality and a lift for those found again."""
    rows = table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("key"), text.url_quality(F.col("url"), ("example.org",), ("blog.",)).alias("quality"))
    by = W.partitionBy("key")
    rows = rows.withColumn("n", F.count("*").over(by)).withColumn("k", F.row_number().over(by.orderBy("page_id"))).where("k = 1")
    return rows.select("page_id", "key", "quality", F.round(F.col("quality") + 0.5 * (F.col("n") - 1), 6).alias("score"))


_ENTITY_SQL = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _e, _c in text.ENTITIES.items():
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '{_e}', chr({ord(_c)}))"


@query(f"SELECT page_id, md5(trim(regexp_replace({_ENTITY_SQL}, '[\\s ]+', ' ', 'g'))) AS digest FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("digest"))


@query("""SELECT doc_id, substr(md5(concat_ws(':', nullif(source, ''), nullif(lang, ''), substr(md5(text), 1, 8))), 1, 16) AS chunk_id FROM documents""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of texts from their place and content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.chunk_id(F.col("text"), F.col("source"), F.col("lang")).alias("chunk_id"))


@query("SELECT lang AS topic, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY lang", total="BIGINT")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by topic and in all."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("n"))
    return rows.crossJoin(rows.agg(F.sum("n").alias("total")))  # one row beside a few
