"""Queries of stores: vector upserts, corrections as ordered state, and search over summary trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import entities
from lodestone.operators import corrections, graph_store, mixtures, trees, upserts, vectors
from lodestone.registry import query, table

_BUDGET = 400_000


@query(f"""WITH RECURSIVE c AS (SELECT lang AS topic, doc_id, greatest(1, coalesce(length(text), 0) // 4) AS tokens, embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AS fit, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position
 FROM documents LEFT JOIN embeddings ON vec_id = doc_id), b AS (SELECT *, (position - 1) // 128 AS batch, (position - 1) % 128 AS k FROM c),
r AS (SELECT topic, batch, k, tokens, fit, CAST(1 AS BIGINT) AS n, tokens AS most, 0 AS sub_batch FROM b WHERE k = 0
 UNION ALL SELECT topic, batch, k, tokens, fit, CASE WHEN is_over THEN 1 ELSE n + 1 END, CASE WHEN is_over THEN tokens ELSE greatest(most, tokens) END, sub_batch + CASE WHEN is_over THEN 1 ELSE 0 END
 FROM (SELECT b.topic, b.batch, b.k, b.tokens, b.fit, r.n, r.most, r.sub_batch, (r.n + 1) * greatest(r.most, b.tokens) * greatest(r.most, b.tokens) > {_BUDGET} AS is_over FROM r JOIN b ON b.topic = r.topic AND b.batch = r.batch AND b.k = r.k + 1))
SELECT topic, batch, sub_batch, count(*) AS n, max(tokens) AS most, count(*) * max(tokens) * max(tokens) AS cost, count(*) FILTER (WHERE fit) AS ok, count(*) FILTER (WHERE NOT fit) AS failed FROM r GROUP BY topic, batch, sub_batch""", batch="BIGINT", sub_batch="INT", most="BIGINT", cost="BIGINT")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their language, in upserts of 128, embedded in sub-batches within a budget of tokens squared;
    those without a fit vector fail."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), upserts.finite(F.col("embedding"), 64).alias("fit"))
    chunks = table(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), "doc_id", "text").join(v, "doc_id", "left").withColumn("fit", F.coalesce("fit", F.lit(False)))
    return upserts.outcome(upserts.batched(chunks, "topic", "doc_id", "text", ["fit"], budget=_BUDGET), "topic", "fit")


_SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH RECURSIVE g AS (SELECT conv_id, list(text ORDER BY turn, text) FILTER (WHERE role = 'system') AS firm, list(text ORDER BY turn, text) FILTER (WHERE role = 'user') AS learned FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
r AS (SELECT conv_id, coalesce(learned, []) AS learned, 0 AS i, coalesce(firm, [])[1:3] AS kept FROM g
 UNION ALL SELECT conv_id, learned, i + 1, CASE WHEN len(kept) >= 3 OR len(list_filter(kept, lambda e: len(list_intersect({_SPLIT.format('e')}, {_SPLIT.format('learned[i + 1]')})) >= 3)) > 0 THEN kept ELSE list_append(kept, learned[i + 1]) END FROM r WHERE i < len(learned))
SELECT conv_id, len(kept) AS n, md5(array_to_string(kept, chr(10))) AS digest FROM r WHERE i = len(learned)""", n="INT")
def corrections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a session's firm corrections (what its system turns say) and learned ones (its users' turns) the first three that don't
    say the same."""
    texts = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    rows = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(texts("system").alias("firm"), texts("user").alias("learned"))
    kept = corrections.merged(F.col("firm"), F.col("learned"))
    return rows.select("conv_id", kept.alias("kept")).select("conv_id", F.size("kept").alias("n"), F.md5(F.array_join("kept", "\n")).alias("digest"))


@query("""WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS correction FROM events), f AS (SELECT user_id, ts, event_id AS feedback_id, event_type = 'purchase' AS positive FROM e WHERE event_type IN ('purchase', 'error')),
a AS (SELECT user_id, ts AS applied, correction FROM e WHERE event_type NOT IN ('purchase', 'error')), j AS (SELECT DISTINCT correction, feedback_id, ts, positive FROM a ASOF JOIN f ON a.user_id = f.user_id AND a.applied <= f.ts WHERE f.ts < a.applied + INTERVAL 86400 SECOND),
m AS (SELECT *, row_number() OVER (PARTITION BY correction ORDER BY ts, feedback_id) AS k FROM j),
r AS (SELECT correction, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS feedback_id, CAST(NULL AS TIMESTAMP) AS ts, 80 AS conf, true AS active FROM m GROUP BY correction
 UNION ALL SELECT correction, k, feedback_id, ts, value, active AND NOT (NOT positive AND value < 30) FROM (SELECT m.*, r.active, CASE WHEN m.positive THEN least(100, r.conf + 5) ELSE greatest(0, r.conf - 15) END AS value FROM r JOIN m ON m.correction = r.correction AND m.k = r.k + 1))
SELECT correction, feedback_id, ts, round(conf / 100, 2) AS confidence, active FROM r WHERE k > 0""")
def correction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences of corrections (the numbers that events name) after each purchase or error of a user who had applied
    them within a day, with floor and cap, and whether they were given up."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("session"), "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("correction"))
    said = F.col("event_type").isin("purchase", "error")
    feedback = rows.where(said).select("session", F.col("event_id").alias("feedback_id"), "ts", (F.col("event_type") == "purchase").alias("positive"))
    moves = corrections.touched(rows.where(~said).select("session", "correction", "ts"), feedback, 86400)
    return corrections.confidences(moves, F.date_trunc("day", F.col("ts").cast("timestamp")))


def _nodes(k: int) -> str:
    size = "true" if k == 0 else f"ceil(n0 / {10 ** (k - 1)}) >= 5"
    return f"SELECT topic, {k} AS level, node0 // {10**k} AS node, list(m ORDER BY pos) AS v, any_value(vec_id) AS leaf FROM (SELECT topic, node0 // {10**k} * {10**k} AS node0, pos, avg(x) AS m, max(CASE WHEN {k} = 0 THEN vec_id END) AS vec_id FROM p WHERE {size} GROUP BY topic, node0 // {10**k}, pos) GROUP BY topic, node0"


_TREE = f"""l AS (SELECT label AS topic, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS node0, count(*) OVER (PARTITION BY label) AS n0 FROM embeddings), p AS (SELECT topic, vec_id, node0, n0, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM l),
t AS ({' UNION ALL '.join(_nodes(k) for k in range(4))}), q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0)"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors.valid(table(spark, sf_dir, "embeddings"), 64)
    nodes = trees.built(rows.select(F.col("label").alias("topic"), F.col("vec_id").alias("leaf"), F.col("embedding").alias("v")))
    return nodes, rows.where("vec_id % 50 = 0").select("vec_id", F.col("embedding").alias("v"))


@query(f"""WITH {_TREE}, s AS (SELECT query_id, CASE WHEN level = 0 THEN leaf ELSE -(level * 1000000000000000 + topic * 100000000000 + node) END AS node_id, round(list_cosine_similarity(qv, v), 6) + 0.0 AS score FROM q, t)
SELECT query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s WHERE node_id <> query_id) WHERE rank <= 10""", rank="INT")
def tree_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest nodes of all levels of the topics' summary trees to each query vector."""
    nodes, queries = _tree(spark, sf_dir)
    return trees.collapsed(nodes, queries, 10)


def _kept(k: int) -> str:
    from_above = f" UNION ALL SELECT k{k + 1}.query_id, t.topic, t.node, t.leaf, t.v, qv FROM k{k + 1} JOIN t ON t.topic = k{k + 1}.topic AND t.level = {k} AND t.node // 10 = k{k + 1}.node JOIN q ON q.query_id = k{k + 1}.query_id" if k < 3 else ""
    return f"""k{k} AS (SELECT query_id, topic, node, leaf, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, topic ORDER BY score DESC, node) AS k FROM (SELECT query_id, topic, node, leaf, round(list_cosine_similarity(qv, v), 6) AS score
 FROM (SELECT q.query_id, t.topic, t.node, t.leaf, t.v, qv FROM q, t JOIN h ON h.topic = t.topic AND h.top = t.level WHERE t.level = {k}{from_above}) WHERE leaf IS NULL OR leaf <> query_id)) WHERE k <= 3)"""


@query(f"""WITH {_TREE}, h AS (SELECT topic, max(level) AS top FROM t GROUP BY topic), {', '.join(_kept(k) for k in (3, 2, 1, 0))}
SELECT query_id, topic, leaf, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leaf) AS rank FROM k0) WHERE rank <= 5""", rank="INT")
def tree_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query vector, from the highest level of each topic's tree down by the three best nodes, the five best leaves."""
    nodes, queries = _tree(spark, sf_dir)
    return trees.descended(nodes, queries, 5)


_FOUND = " UNION ALL ".join("SELECT lang, doc_id, lower(unnest(regexp_extract_all(text, '" + p.replace("'", "''") + f"'))) AS name, '{label}' AS label FROM documents" for label, p, _ in entities.KINDS)


@query(f"""WITH x AS (SELECT DISTINCT lang, doc_id, label, name FROM ({_FOUND}) WHERE lang IS NOT NULL AND doc_id IS NOT NULL), k AS (SELECT * FROM x WHERE lang <> (SELECT min(lang) FROM documents))
SELECT label, name, count(*) AS chunks, count(DISTINCT lang) AS topics FROM k GROUP BY label, name""")
def graph_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of all documents' entities, built in two batches, the first applied twice; then one
    topic rebuilt and one deleted."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), F.col("doc_id").alias("chunk_id"), "text")

    def mentions(rows: DataFrame) -> DataFrame:
        found = entities.extracted(rows.select(F.struct("topic", "chunk_id").alias("of"), "text"), "of", "text")
        return found.select("of.topic", "of.chunk_id", "label", F.lower("name").alias("name"))

    store = graph_store.GraphStore(spark)
    first = mentions(docs.where("chunk_id % 2 = 0"))
    store.merge(first)
    store.merge(mentions(store.new_chunks(docs)))  # what the store has no mention of: the other half, and texts without names
    store.merge(first)
    topics = sorted(r.topic for r in docs.select("topic").where("topic is not null").distinct().collect())
    store.rebuild(topics[-1:], lambda own: mentions(docs.where(F.col("topic").isin(*own))))
    store.delete_topics(topics[:1])
    return store.entities()


@query()
def topic_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic's vectors in soft clusters, a component for each ten rows."""
    rows = vectors.valid(table(spark, sf_dir, "embeddings"), 64).select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = mixtures.clustered(rows)
    return found.select(F.col("group").alias("topic"), F.col("id").alias("vec_id"), "cluster", F.round("probability", 6).alias("probability"), "members")
