"""Queries of graph, chunking, cluster and evaluation operators. Orders and parts stand for chunks and their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import entities, text, units
from lodestone.operators import chunking, clusters, communities, evaluation, graph, vectors
from lodestone.plans.search_queries import _BM25, _TOKENS, _bm25, _with_documents
from lodestone.registry import ORACLES, query, table


def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem), n AS (SELECT a.c AS chunk, b.c AS other, count(*) AS n FROM p a JOIN p b ON a.e = b.e AND a.c <> b.c WHERE a.c % 50 = 0 GROUP BY 1, 2)
SELECT chunk, other, n, least(1.0, n / 5) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n DESC, other) AS rank FROM n) WHERE rank <= 10""")
def shared_entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten orders that share most parts with each fiftieth order."""
    rows = _contains(spark, sf_dir)
    return graph.shared(rows, "l_orderkey", "l_partkey", rows.where("l_orderkey % 50 = 0"), 10)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem) SELECT p_partkey, p_name, count(c) AS degree FROM part LEFT JOIN p ON e = p_partkey WHERE contains(lower(p_name), 'a') GROUP BY 1, 2 ORDER BY degree DESC, p_partkey LIMIT 100 OFFSET 20""")
def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the entities with some text in their names, by degree."""
    degree = _contains(spark, sf_dir).distinct().groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("degree"))
    rows = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("a"))).select("p_partkey", "p_name").join(degree, "p_partkey", "left").na.fill(0, ["degree"])
    return rows.orderBy(F.desc("degree"), "p_partkey").offset(20).limit(100)


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), v AS (SELECT 'Order' AS label, count(DISTINCT l_orderkey) AS n FROM e UNION ALL SELECT 'Part', count(DISTINCT l_partkey) FROM e)
SELECT label, n, round(2.0 * (SELECT count(*) FROM e) / (SELECT sum(n) FROM v), 6) AS average_degree FROM v""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices by label, and the average degree."""
    e = _contains(spark, sf_dir).distinct()
    ids = e.select(F.lit("Order").alias("label"), F.col("l_orderkey").alias("id")).unionByName(e.select(F.lit("Part").alias("label"), F.col("l_partkey").alias("id"))).distinct()
    n = ids.groupBy("label").agg(F.count("*").alias("n"))
    sums = n.agg(F.sum("n").alias("vertices")).crossJoin(e.agg(F.count("*").alias("edges")))  # one row
    return n.crossJoin(F.broadcast(sums)).select("label", "n", F.round(2.0 * F.col("edges") / F.col("vertices"), 6).alias("average_degree"))


_EDGES = "e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


def _hop_scores(spark: SparkSession, sf_dir: str, parts: DataFrame) -> DataFrame:
    """What lies within two steps of the parts, and its score. Steps go over whole numbers, even ones for orders and odd ones
    for parts, which take less room than names; where keys are too large for that, over names."""
    rows = table(spark, sf_dir, "lineitem")
    ends = lambda df, *cols: [abs(x) for x in df.agg(*(f(c) for c in cols for f in (F.min, F.max))).first() if x is not None]
    if max([*ends(rows, "l_orderkey", "l_partkey"), *ends(parts, "p_partkey")], default=0) >= 2**62:
        return graph.hop_scores(graph.hops(_edges(spark, sf_dir), parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")), 2))
    code = lambda c, kind: F.shiftleft(F.col(c).cast("long"), 1).bitwiseOR(F.lit(kind))
    found = graph.hops(rows.select(code("l_orderkey", 0).alias("src"), code("l_partkey", 1).alias("dst")), parts.select(code("p_partkey", 1).alias("id")), 2)
    name = lambda c: F.concat(F.when(F.col(c).bitwiseAND(F.lit(1)) == 1, "p").otherwise("o"), F.shiftright(c, 1).cast("string"))
    found = found.sortWithinPartitions("seed", "id")  # what is written is half as large
    return graph.hop_scores(found.select(name("seed").alias("seed"), name("id").alias("id"), "hops"))


@query(f"""WITH {_EDGES}, s AS (SELECT 'p' || p_partkey AS seed FROM part WHERE p_partkey % 50 = 0), h1 AS (SELECT DISTINCT seed, dst AS id FROM s JOIN u ON src = seed), h2 AS (SELECT DISTINCT seed, dst AS id FROM h1 JOIN u ON src = id)
, f AS (SELECT seed, seed AS id, 0 AS hops FROM s UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) SELECT seed, id, min(hops) AS hops, CASE min(hops) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.2 END AS score FROM f GROUP BY seed, id""", score="DOUBLE")
def hop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of each fiftieth part, the stated query set, and its score."""
    return _hop_scores(spark, sf_dir, table(spark, sf_dir, "part").where("p_partkey % 50 = 0"))


@query(ORACLES["hop_scores"].replace(" WHERE p_partkey % 50 = 0", ""))
def hop_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of every part, and its score."""
    return _hop_scores(spark, sf_dir, table(spark, sf_dir, "part"))


@query(f"""WITH {_EDGES} SELECT id, direction, count(*) AS n, min(other) AS first FROM (SELECT src AS id, dst AS other, 'outgoing' AS direction FROM e UNION ALL SELECT dst, src, 'incoming' FROM e) GROUP BY id, direction""")
def entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each vertex in either direction."""
    return graph.details(_edges(spark, sf_dir)).groupBy("id", "direction").agg(F.count("*").alias("n"), F.min("other").alias("first"))


@query(f"""WITH RECURSIVE {_EDGES}, c(id, community) USING KEY (id) AS (SELECT src, min(src) FROM u GROUP BY src UNION
 SELECT u.src, min(c.community) FROM u JOIN c ON c.id = u.dst JOIN recurring.c AS own ON own.id = u.src WHERE c.community < own.community GROUP BY u.src) SELECT id, community FROM c""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the graph of all orders and parts."""
    return graph.communities(_edges(spark, sf_dir))


@query()
def leiden_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the graph of all orders (chunks) and parts (entities) at three resolutions, those of three orders or more."""
    edges = _edges(spark, sf_dir)
    return communities.described(communities.leiden(edges, passes=1), edges.select(F.col("src").alias("id")))


_LABELLED = " UNION ALL ".join("SELECT doc_id, unnest(regexp_extract_all(text, '" + p.replace("'", "''") + f"')) AS name, '{label}' AS label, {c} AS confidence FROM documents" for label, p, c in entities.KINDS)


@query(f"""WITH x AS ({_LABELLED}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name), label ORDER BY confidence DESC, name) AS n FROM x) SELECT doc_id, name, label, confidence FROM r WHERE n = 1""", confidence="DOUBLE")
def entity_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled names in documents, each once."""
    return entities.deduplicated(entities.extracted(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"""WITH x AS (SELECT DISTINCT doc_id, lower(name) AS name, label FROM ({_LABELLED})) SELECT name, label, count(*) AS chunks, min(doc_id) AS first, coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 1), -1) AS first_new FROM x GROUP BY name, label""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the corpus graph with the chunks that hold them (odd ids stand for those not built yet)."""
    found = entities.extracted(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.lower("name").alias("name"), "label").distinct()
    return found.groupBy("name", "label").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first"), F.coalesce(F.min(F.when(F.col("doc_id") % 2 == 1, F.col("doc_id"))), F.lit(-1)).alias("first_new"))


def places(name: str, pattern: str) -> str:
    """SQL for (doc_id, found, at_char): what stands before a match is what splitting leaves, and the matches before it."""
    return f"""{name} AS (SELECT doc_id, ms[k] AS found, list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS at_char
 FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM documents)))"""


@query(f"WITH {places('x', chr(92) + 'bLicense' + chr(92) + 'b')}, {places('y', chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b')} SELECT doc_id, x.found AS a, y.found AS b, count(*) AS n FROM x JOIN y USING (doc_id) WHERE abs(x.at_char - y.at_char) <= 300 GROUP BY 1, 2, 3")
def entity_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences within 300 characters of a year or number."""
    return graph.near_each_other(table(spark, sf_dir, "documents"), "doc_id", "text", r"\bLicense\b", r"\b\d+\b", 300)


@query("""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT *, CASE WHEN regexp_matches(trim(line), '^(?:Chapter|CHAPTER)\\s+\\d+[:\\.\\s]') THEN 1 WHEN regexp_matches(trim(line), '^(?:PART|Part)\\s+[IVX\\d]+[:\\.\\s]') THEN 1 WHEN regexp_matches(trim(line), '^\\d+\\.\\s+[A-Z][A-Za-z]') THEN 2 WHEN regexp_matches(trim(line), '^\\d+\\.\\d+\\s+[A-Z][A-Za-z]') THEN 3
 WHEN regexp_matches(trim(line), '^\\d+\\.\\d+\\.\\d+\\s+[A-Z][A-Za-z]') THEN 4 WHEN regexp_matches(trim(line), '^#{1,4}\\s+') THEN length(regexp_extract(trim(line), '^(#+)', 1)) END AS level FROM l),
s AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT doc_id, section, coalesce(max(CASE WHEN level IS NOT NULL THEN trim(line) END), '') AS heading, coalesce(max(level), 0) AS level, md5(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY i)) AS digest FROM s GROUP BY doc_id, section HAVING count(*) FILTER (WHERE level IS NULL) > 0""", section="BIGINT")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents by their headings."""
    rows = chunking.sections(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "section", "heading", "level", F.md5("body").alias("digest"))


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents (each line a paragraph) as chunks with overlap, long ones by sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = chunking.split_long(chunking.chunks(docs, size=1000, overlap=150), "content", 1600)
    return rows.select("doc_id", "section", "chunk_index", "sub_chunk", F.length("content").alias("chars"), F.md5("content").alias("digest"))


_BARE = "trim(regexp_replace({0}, '^#+\\s*', ''))"
_CONFIGS = ", ".join(f"({a}, {b})" for a, b in chunking.matrix())
_SECTIONS = "WITH " + ORACLES["chunk_sections"].split("FROM (WITH ", 1)[1].split("SELECT doc_id, section,")[0]


@query(f"""{_SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1)}, t AS (SELECT *, last_value(CASE WHEN level <= 2 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chapter FROM s),
g AS (SELECT doc_id, section, coalesce(max(CASE WHEN level IS NOT NULL THEN trim(line) END), '') AS heading, coalesce(arg_max(chapter, i), '') AS chapter, list(CAST(length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS BIGINT) ORDER BY i) FILTER (WHERE level IS NULL AND regexp_replace(line, '\\s', '', 'g') <> '') AS ls FROM t GROUP BY doc_id, section),
b AS (SELECT doc_id, section, ls, {_BARE.format("heading")} AS h, left({_BARE.format("chapter")}, 50) AS c FROM g WHERE len(ls) > 0),
x AS (SELECT doc_id, section, ls, CASE WHEN h = '' AND c = '' THEN 0 ELSE CASE WHEN c = '' THEN 0 ELSE length(c) + 11 END + CASE WHEN h = '' THEN 0 ELSE length(h) + 11 END + CASE WHEN h <> '' AND c <> '' THEN 1 ELSE 0 END + 2 END AS line FROM b),
f AS (SELECT doc_id, section, ls, line, size, overlap, 0 AS i, CAST([] AS BIGINT[]) AS now, 0 AS chunks, 0 AS chars FROM x, (VALUES {_CONFIGS}) AS v(size, overlap)
 UNION ALL SELECT doc_id, section, ls, line, size, overlap, i + 1, CASE WHEN is_full THEN list_append(now[len(now) - len(list_filter(range(1, len(now) + 1), lambda j: list_sum(now[len(now) - j + 1:]) <= overlap)) + 1:], p) ELSE list_append(now, p) END,
 chunks + CASE WHEN is_full AND span >= 100 THEN 1 ELSE 0 END, chars + CASE WHEN is_full AND span >= 100 THEN span ELSE 0 END FROM (SELECT *, ls[i + 1] AS p, len(now) > 0 AND list_sum(now) + ls[i + 1] > size AS is_full, list_sum(now) + 2 * (len(now) - 1) AS span FROM f WHERE i < len(ls))),
e AS (SELECT size, overlap, line, chunks + CASE WHEN span >= 100 THEN 1 ELSE 0 END AS chunks, chars + CASE WHEN span >= 100 THEN span WHEN chunks > 0 THEN span + 2 ELSE 0 END AS chars FROM (SELECT *, list_sum(now) + 2 * (len(now) - 1) AS span FROM f WHERE i = len(ls))),
n AS (SELECT size, overlap, sum(chunks) AS chunks, sum(chars) AS bare, sum(chunks * line) AS lines FROM e GROUP BY size, overlap)
SELECT 'c' || size || '_o' || overlap || '_p' || CAST(prefixed AS INT) AS config_id, size, overlap, prefixed, chunks, bare + CASE WHEN prefixed THEN lines ELSE 0 END AS chars FROM n, (VALUES (false), (true)) AS v(prefixed)""", size="INT", overlap="INT", chunks="BIGINT", chars="BIGINT")
def chunk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 114 configurations of size, overlap and context, over whole documents (each line a paragraph)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.swept(docs)


_UNIT_VECTOR = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"""WITH RECURSIVE v AS (SELECT label AS grp, vec_id, {_UNIT_VECTOR} AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT v.grp, v.n, v.vec_id, v.vec_id AS cluster, [{{'id': v.vec_id, 'e': v.e}}] AS seeds FROM v WHERE n = 1 UNION ALL
 SELECT grp, n, vec_id, coalesce(hit, vec_id), CASE WHEN hit IS NULL THEN list_append(seeds, {{'id': vec_id, 'e': e}}) ELSE seeds END FROM (SELECT v.grp, v.n, v.vec_id, v.e, r.seeds, list_filter(r.seeds, lambda s: list_dot_product(s.e, v.e) >= 0.5)[1].id AS hit FROM r JOIN v ON v.grp = r.grp AND v.n = r.n + 1))
SELECT grp AS group, vec_id AS id, cluster FROM r""".replace("AS group", 'AS "group"'))
def threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of each label's vectors."""
    return clusters.by_threshold(vectors.valid(table(spark, sf_dir, "embeddings"), 64), F.col("label"), 0.5).select("group", "id", "cluster")


@query()
def mixture_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all vectors by a Gaussian mixture."""
    return clusters.mixture(vectors.valid(table(spark, sf_dir, "embeddings"), 64), 10)


_CUT = "substr({0}, 1, 500)"
_LAST = "CASE WHEN contains(substr({0}, 1, 500), '{1}') THEN length(substr({0}, 1, 500)) - strpos(reverse(substr({0}, 1, 500)), '{2}') - {3} ELSE -1 END"


def _summary(x: str) -> str:
    """SQL for the text cut at a sentence's end, else at a space, if past the half."""
    marks = "".join(f" WHEN {_LAST.format(x, m, m[::-1], len(m) - 1)} > 250 THEN substr({x}, 1, {_LAST.format(x, m, m[::-1], len(m) - 1)} + 1)" for m in (". ", "! ", "? "))
    space = _LAST.format(x, " ", " ", 0)
    return f"CASE WHEN length({x}) <= 500 THEN {x}{marks} WHEN {space} > 250 THEN substr({x}, 1, {space}) || '...' ELSE {_CUT.format(x)} || '...' END"


def _level(k: int) -> str:
    whole = f"SELECT {k} AS level, node // 10 AS node, string_agg(content, ' ' ORDER BY node) AS t FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) >= 5 GROUP BY node // 10"
    return f"l{k} AS (SELECT level, node, {_summary('t')} AS content FROM ({whole}))"


_HIGHEST = "(SELECT max(level) FROM (" + " UNION ALL ".join(f"SELECT level FROM l{k}" for k in range(4)) + "))"


@query(f"WITH l0 AS (SELECT 0 AS level, doc_id AS node, text AS content FROM documents), {_level(1)}, {_level(2)}, {_level(3)}, top AS (SELECT {_HIGHEST} AS m) SELECT level, node, CASE WHEN level < m THEN node // 10 END AS parent, md5(content) AS digest FROM (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(4)) + "), top")
def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of extractive summaries over all documents, ten children a node."""
    leaves = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.col("text").alias("content"))
    return clusters.tree(leaves, 10, 500).select("level", "node", "parent", F.md5("content").alias("digest"))


_PAIRS = (("m", "ft"), ("kpa", "psi"), ("kg", "lb"), ("Celsius", "f"), ("feet", "m"), ("m", "kg"), ("l", "L"))
_VALUES = ", ".join(f"('{a}', '{b}', {f!r})" for a, b, f in units.FACTORS)
_CASE = lambda i: "CASE l_linenumber " + " ".join(f"WHEN {n} THEN '{p[i]}'" for n, p in enumerate(_PAIRS, 1)) + " END"
_UNIT = lambda x: "CASE lower({0}) ".format(x) + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in units.ALIASES.items()) + f" ELSE lower({x}) END"


@query(f"""WITH f AS (SELECT * FROM (VALUES {_VALUES}) AS t(a, b, x)), v AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, {_UNIT(_CASE(0))} AS ua, {_UNIT(_CASE(1))} AS ub FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ua = 'c' AND ub = 'f' THEN round(v * 9 / 5 + 32, 2) WHEN x IS NOT NULL THEN v * x WHEN ua = ub THEN v END, 4) AS converted FROM v LEFT JOIN f ON a = ua AND b = ub""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in other units."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_CASE(0)).alias("ua"), F.expr(_CASE(1)).alias("ub"))
    return units.converted(rows, "l_quantity", "ua", "ub").select("l_orderkey", "l_linenumber", F.round("converted", 4).alias("converted"))


_METRICS = f"""{_BM25.strip()}, b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ranked WHERE rank <= 5),
kw AS (SELECT item_id AS query_id, list_sort(list_distinct({_TOKENS}))[1:6] AS keywords FROM benchmark),
l AS (SELECT b.query_id, b.rank, d.source, keywords, list_filter(keywords, lambda k: contains(lower(d.text), lower(k))) AS found FROM b JOIN documents d USING (doc_id) JOIN kw USING (query_id) WHERE rank <= 5),
r AS (SELECT *, len(found) / len(keywords) AS rel FROM l), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM r),
m AS (SELECT query_id, len(list_distinct(flatten(list(found)))) / any_value(len(keywords)) AS keyword, coalesce(1 / min(CASE WHEN len(found) >= greatest(1, len(keywords) // 2) THEN rank END), 0.0) AS mrr, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(ideal + 1)) AS idcg, count(DISTINCT source) / count(*) AS diversity FROM i GROUP BY query_id),
s AS (SELECT query_id, keyword, mrr, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, diversity FROM m), c AS (SELECT *, keyword * 0.35 + keyword * 0.15 + mrr * 0.20 + ndcg * 0.15 + diversity * 0.10 + 0.05 * (1 - (query_id % 20) * 50.0 / 2000) AS composite FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.array_sort(F.array_distinct(text.tokens(F.col("text")))), 1, 6)
    keywords = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("keywords"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best = _bm25(spark, sf_dir, 5).withColumn("rank", rank).where("rank <= 5").select("query_id", "doc_id", "rank")
    rows = _with_documents(best, spark, sf_dir, "text", "source").join(keywords, "query_id").withColumn("ms", F.col("query_id") % 20 * 50.0)
    return evaluation.per_query(rows)


@query(f"WITH {_METRICS} SELECT query_id, round(keyword, 6) AS keyword, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(diversity, 6) AS diversity, round(composite, 5) AS composite FROM c")
def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the lexical search for each question (six of its words are what it expects)."""
    return _scored(spark, sf_dir).select("query_id", *(F.round(k, 6).alias(k) for k in ("keyword", "mrr", "ndcg", "diversity")), F.round("composite", 5).alias("composite"))


@query(f"WITH {_METRICS}, t AS (SELECT query_id % 5 AS tier, avg(composite) AS mean, coalesce(stddev_samp(composite), 0.0) AS stdev, count(*) AS n FROM c GROUP BY 1) SELECT tier, round(mean, 5) AS mean, round(stdev, 5) AS stdev, n, round((SELECT avg(mean) FROM t), 5) AS macro FROM t")
def macro_average_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by tier, and the mean of these."""
    rows = evaluation.by_tier(_scored(spark, sf_dir).withColumn("tier", F.col("query_id") % 5), "tier", "composite")
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("mean").alias("macro")))).select("tier", F.round("mean", 5).alias("mean"), F.round("stdev", 5).alias("stdev"), "n", F.round("macro", 5).alias("macro"))  # one row beside a few


@query(f"WITH {_METRICS} SELECT query_id % 5 AS tier, count(*) FILTER (WHERE keyword - ndcg > 0.01) AS wins, count(*) FILTER (WHERE abs(keyword - ndcg) <= 0.01) AS ties, count(*) FILTER (WHERE keyword - ndcg < -0.01) AS losses, round(avg(keyword - ndcg), 5) AS mean_delta FROM c GROUP BY 1")
def ceiling_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, ties and losses of one measure against another by tier."""
    rows = evaluation.wins(_scored(spark, sf_dir).withColumn("tier", F.col("query_id") % 5), "tier", "keyword", "ndcg")
    return rows.select("tier", "wins", "ties", "losses", F.round("mean_delta", 5).alias("mean_delta"))


@query("SELECT l.quality AS tier, round(avg(d.n_chars) FILTER (WHERE l.toxic = 1) - avg(d.n_chars) FILTER (WHERE l.toxic = 0), 4) AS delta FROM documents d JOIN labels l USING (doc_id) GROUP BY l.quality")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a switch (toxic or not) does to a mean, by tier."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("tier"), (F.col("toxic") == 1).alias("on"), "n_chars")
    return evaluation.ablation(rows, "tier", "on", "n_chars").select("tier", F.round("delta", 4).alias("delta"))


@query("""WITH v AS (SELECT event_type AS phase, user_id % 7 AS config, round(avg(value), 6) AS composite FROM events GROUP BY 1, 2) SELECT phase, config, composite, row_number() OVER (PARTITION BY phase ORDER BY composite DESC, config) AS rank FROM v""")
def phase_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of each phase, best first."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase"), (F.col("user_id") % 7).alias("config")).agg(F.round(F.avg("value"), 6).alias("composite"))
    return evaluation.ranked_phases(rows, "phase", "config", "composite")


@query("SELECT event_type, " + ", ".join(f"round(max(value) FILTER (WHERE user_id % 5 = {i}), 6) AS c{i}" for i in range(5)) + " FROM events GROUP BY event_type")
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value for each pair of two settings, as a matrix."""
    rows = table(spark, sf_dir, "events").withColumn("c", F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")))
    return rows.groupBy("event_type").pivot("c", [f"c{i}" for i in range(5)]).agg(F.round(F.max("value"), 6))


@query("""WITH m AS (SELECT DISTINCT md5(text) AS hash FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT hash FROM m)""")
def manifest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't in the manifest (which has each third) by their digest."""
    docs = table(spark, sf_dir, "documents").withColumn("hash", F.md5("text"))
    return docs.join(docs.where("doc_id % 3 = 0").select("hash").distinct(), "hash", "left_anti").select("doc_id", "hash")


@query("SELECT source, count(*) AS files, sum(n_chars) AS size, arg_max(doc_id, n_chars * 1000000 - doc_id) AS largest, arg_min(doc_id, n_chars * 1000000 + doc_id) AS smallest FROM documents GROUP BY source", size="BIGINT")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, size, largest and smallest of each source."""
    by = F.col("n_chars") * 1000000
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"), F.max_by("doc_id", by - F.col("doc_id")).alias("largest"), F.min_by("doc_id", by + F.col("doc_id")).alias("smallest"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id < 3)")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of some topics after some sources are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where(F.col("lang").isin("en", "fr")).join(docs.where("doc_id < 3").select("source").distinct(), "source", "left_anti").select("doc_id", "lang", "source")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE k = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert's outcome, each key's last row."""
    rows = table(spark, sf_dir, "events")
    return vectors.last_of_each(rows, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value")
