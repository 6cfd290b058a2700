"""Queries of routing, answers, feedback, structure and the whole retrieval plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import conversation, questions, text
from lodestone.operators import fuzzy, graph, quality
from lodestone.plans.graph_queries import _EDGES, _edges
from lodestone.plans.retrieval import Profile, retrieve
from lodestone.plans.search_queries import _KNN, STOP, _knn, _questions
from lodestone.registry import query, table, words_list

_SYNONYMS = [["the", "this"], ["and", "plus", "also"], ["tion", "ment"]]


@query()
def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion, lexical and dense lists, fusion, gate and diversity for all questions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    dense = _knn(spark, sf_dir, 15).select((F.floor(F.col("query_id") / 50)).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank", "score")
    return retrieve(_questions(spark, sf_dir), docs, F.col("lang"), dense, Profile(expand=_SYNONYMS))


_PAIRS = sorted({(a, b) for g in _SYNONYMS for a in g for b in g if a != b}, key=lambda p: (-len(p[0]), p[0], len(p[1]), p[1]))
_ADDED = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{a}') AND NOT contains(lower(text), '{b}') THEN '{b}' END" for a, b in _PAIRS) + "], lambda x: x IS NOT NULL)"


@query(f"WITH q AS (SELECT item_id, text, {_ADDED} AS f FROM benchmark), d AS (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i)[1:3] AS c FROM q) SELECT item_id, CASE WHEN len(c) > 0 THEN text || ' ' || array_to_string(c, ' ') ELSE text END AS expanded FROM d")
def question_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with synonyms of their terms."""
    return table(spark, sf_dir, "benchmark").select("item_id", questions.expanded(F.col("text"), _SYNONYMS).alias("expanded"))


_TOPICS = {"en": ["the", "and", "ing"], "fr": ["ment", "eau", "les"], "de": ["ung", "sch", "die"], "es": ["ción", "los", "para"]}
_ROUTE = " UNION ALL ".join(f"SELECT item_id, '{k}' AS topic, least(len(list_filter({words_list(v)}, lambda w: contains(lower(text), w))) / 5, 1.0) AS score FROM benchmark" for k, v in _TOPICS.items())


@query(f"SELECT item_id, topic, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, topic) AS rank FROM ({_ROUTE})")
def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics in order of how well they fit each question."""
    topics = F.explode(F.array(*(F.struct(F.lit(k).alias("topic"), F.array(*map(F.lit, v)).alias("words")) for k, v in _TOPICS.items())))
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", topics.alias("t"))
    rows = rows.select("item_id", "t.topic", F.round(questions.route_score(F.col("text"), F.col("t.words")), 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "topic")))


_BROAD = words_list(questions.BROAD)


@query(f"""SELECT conv_id, turn, len(list_filter({_BROAD}, lambda w: contains(lower(text), w))) > 0 OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 4 AS broad, regexp_matches(text, '(?i)\\b(code|script|function|class|import|python|sql)\\b') AS code,
regexp_matches(text, '\\d') AS number, NOT regexp_matches(upper(text), '{questions.WRITES}') AS read_only, len(list_filter({words_list(questions.ABSTAIN)}, lambda w: contains(lower(text), w))) > 0 AS abstains FROM conversations""")
def message_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message is about, by simple signs."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", questions.broad(t).alias("broad"), t.rlike(questions.CODE).alias("code"), t.rlike(questions.NUMBER).alias("number"), questions.read_only(t).alias("read_only"), questions.abstains(t).alias("abstains")
    )


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: NOT list_contains({1}, w)))"


@query(f"""WITH a AS (SELECT conv_id, turn, role, {_CONTENT.format("text", STOP)} AS w, lag({_CONTENT.format("text", STOP)}) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(t) = 0 THEN CASE WHEN len(w) > 0 THEN 1.0 ELSE 0.5 END ELSE len(list_intersect(w, t)) / len(t) END, 6) AS overlap FROM a WHERE role = 'assistant' AND t IS NOT NULL""")
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the message before an answer takes up."""
    rows = table(spark, sf_dir, "conversations").withColumn("w", questions.content_words(F.col("text")))
    rows = rows.withColumn("t", F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' and t is not null")
    return rows.select("conv_id", "turn", F.round(questions.overlap(F.col("w"), F.col("t")), 6).alias("overlap"))


@query("""SELECT event_id, round(CASE WHEN v >= 0.5 THEN least(0.98, 0.85 + (v - 0.5) * 0.26) WHEN v >= 0.3 THEN 0.6 + (v - 0.3) * 1.25 WHEN v >= 0.1 THEN 0.3 + (v - 0.1) * 1.5 ELSE v * 3.0 END, 9) AS score,
round(CASE WHEN ms <= 500 THEN 1.0 WHEN ms <= 2000 THEN 1.0 - (ms - 500) / 1500 * 0.3 WHEN ms <= 5000 THEN 0.7 - (ms - 2000) / 3000 * 0.4 ELSE greatest(0.0, 0.3 - (ms - 5000) / 5000 * 0.3) END, 9) AS speed FROM (SELECT event_id, value / 100 AS v, value * 80 AS ms FROM events)""")
def score_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the session's and the live test's scales."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(questions.session_score(F.col("value") / 100), 9).alias("score"), F.round(questions.live_latency(F.col("value") * 80), 9).alias("speed"))


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(n_chars) FILTER (WHERE k = n * 5 // 100 + 1) AS p5, max(n_chars) FILTER (WHERE k = n * 15 // 100 + 1) AS p15, max(n_chars) FILTER (WHERE k = n // 2 + 1) AS p50, max(n_chars) FILTER (WHERE k = n // 4 + 1) < 100 AS scanned FROM r GROUP BY source""")
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of a source's pages by index, and whether they look scanned."""
    place = lambda share: F.floor(F.col("n") * share / 100)
    rows = quality.at_ranks(table(spark, sf_dir, "documents"), "source", ["n_chars", "doc_id"], {"p5": place(5), "p15": place(15), "p50": place(50), "p25": place(25)})
    return rows.select("source", "p5", "p15", "p50", (F.col("p25") < 100).alias("scanned"))


@query(f"""WITH {_KNN.strip()} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 3 AND score >= 0.3""")
def community_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best summaries with a score of 0.3 or more."""
    return _knn(spark, sf_dir, 3).where("score >= 0.3").select("query_id", "vec_id", "score", "rank")


@query(f"""WITH {_KNN.strip()}, c AS (SELECT unnest(range(0, 20)) / 20.0 AS least) SELECT round(least, 2) AS least, count(vec_id) AS hits, count(DISTINCT query_id) AS queries FROM c LEFT JOIN (SELECT * FROM near WHERE rank <= 10) n ON n.score >= least GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of twenty thresholds leaves of the hits."""
    hits = _knn(spark, sf_dir, 10).select("query_id", "vec_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "score")
    found = hits.where(F.col("score") >= F.col("k") / 20).groupBy("k").agg(F.count("*").alias("hits"), F.count_distinct("query_id").alias("queries"))
    return spark.range(20).select(F.col("id").cast("int").alias("k")).join(found, "k", "left").na.fill(0).select(F.round(F.col("k") / 20, 2).alias("least"), "hits", "queries")


_FIELDS = {"geo": ["the", "ing"], "lab": ["sch", "ung"], "site": ["eau", "ción"]}
_HITS = ", ".join(f"sum(len(list_filter({words_list(v)}, lambda w: contains(lower(text), w)))) AS {k}" for k, v in _FIELDS.items())


@query(f"""WITH s AS (SELECT conv_id, {_HITS} FROM conversations WHERE role = 'user' GROUP BY conv_id), t AS (SELECT *, geo + lab + site AS total, greatest(geo, lab, site) AS most FROM s)
SELECT conv_id, CASE WHEN total = 0 THEN NULL WHEN geo = most THEN 'geo' WHEN lab = most THEN 'lab' ELSE 'site' END AS main, round(CASE WHEN total > 0 THEN most / total ELSE 1 / 3 END, 6) AS share FROM t""")
def specialties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's field by the words of its messages."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = rows.groupBy("conv_id").agg(*(F.sum(text.hits(F.col("text"), F.array(*map(F.lit, v)))).alias(k) for k, v in _FIELDS.items()))
    total, most = sum(F.col(k) for k in _FIELDS), F.greatest(*_FIELDS)
    main = F.when(total == 0, None).when(F.col("geo") == most, "geo").when(F.col("lab") == most, "lab").otherwise("site")
    return n.select("conv_id", main.alias("main"), F.round(F.when(total > 0, most / total).otherwise(1 / 3), 6).alias("share"))


@query(f"""WITH k AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3)) AS words FROM benchmark), m AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3)) AS words FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, item_id, round(least(len(list_intersect(m.words, k.words)) / 5, 1.0) + 0.08, 6) AS score FROM m CROSS JOIN k), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0.1) SELECT conv_id, turn, item_id, score, rank FROM r WHERE rank <= 2""")
def correction_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two corrections (benchmark items stand for them, each with confidence 0.8) that fit a message best,
    by words in common. Corrections meet messages by word, not all with all."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), lambda w: F.length(w) >= 3))
    known = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("w"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(words(F.col("text"))).alias("w"))
    score = F.round(F.least(F.count("*") / 5, F.lit(1.0)) + 0.08, 6)
    rows = asked.join(known, "w").groupBy("conv_id", "turn", "item_id").agg(score.alias("score")).where("score > 0.1")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "item_id"))).where("rank <= 2")


@query("""WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
j AS (SELECT f.event_id, f.value FROM f WHERE EXISTS (SELECT 1 FROM a WHERE a.user_id = f.user_id AND a.ts <= f.ts AND a.ts >= f.ts - INTERVAL 1 DAY)), c AS (SELECT event_id, CASE WHEN value > 50 THEN least(1.0, 0.8 + 0.05) ELSE greatest(0.0, 0.8 - 0.15) END AS confidence FROM j) SELECT event_id, round(confidence, 6) AS confidence, confidence >= 0.7 AS active FROM c""", confidence="DOUBLE")
def correction_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences after feedback within a day of an application."""
    rows = table(spark, sf_dir, "events")
    ends = rows.agg(F.min("event_type").alias("a"), F.max("event_type").alias("f")).first()
    used = rows.where(F.col("event_type") == ends.a).select("user_id", F.col("ts").alias("used"))
    near = (F.col("used") <= F.col("ts")) & (F.col("used") >= F.col("ts") - F.expr("INTERVAL 1 DAY"))
    said = rows.where(F.col("event_type") == ends.f).alias("s").join(used.alias("u"), (F.col("s.user_id") == F.col("u.user_id")) & near, "left_semi")
    sure = F.when(F.col("value") > 50, F.least(F.lit(1.0), F.lit(0.8) + 0.05)).otherwise(F.greatest(F.lit(0.0), F.lit(0.8) - 0.15))
    return said.select("event_id", F.round(sure, 6).alias("confidence"), (sure >= 0.7).alias("active"))


@query(f"WITH {_EDGES}, v AS (SELECT src AS id FROM u GROUP BY src ORDER BY md5(src), src LIMIT 50) SELECT src, dst FROM e WHERE src IN (SELECT id FROM v) OR dst IN (SELECT id FROM v)")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vertices, in order of a hash, with their edges."""
    e = _edges(spark, sf_dir)
    v = graph.both_ways(e).select(F.col("src").alias("id")).distinct().orderBy(F.md5("id"), "id").limit(50)
    out = e.join(v, e.src == v.id, "left_semi").unionByName(e.join(v, e.dst == v.id, "left_semi"))
    return out.distinct()


_NAMES = "n AS (SELECT DISTINCT 'Part' AS label, p_name AS name FROM part UNION SELECT 'Brand', p_brand FROM part UNION SELECT 'Type', p_type FROM part UNION SELECT 'Supplier', s_name FROM supplier UNION SELECT 'Segment', c_mktsegment FROM customer)"


@query(rf"""WITH {_NAMES}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{fuzzy.WORD}')) AS word FROM documents), t AS (SELECT DISTINCT label, name, unnest(regexp_extract_all(lower(name), '{fuzzy.WORD}')) AS term FROM n),
f AS (SELECT word, term, levenshtein(word, term) AS distance FROM w JOIN (SELECT DISTINCT term FROM t) ON abs(length(word) - length(term)) <= 2 WHERE levenshtein(word, term) <= 2),
a AS (SELECT word, label, name, min(distance) AS distance, round(max(1 - distance / greatest(length(term), length(word))), 6) AS score FROM f JOIN t USING (term) GROUP BY ALL
 UNION ALL SELECT word, label, name, -1, 1.0 FROM (SELECT word FROM w WHERE word NOT IN (SELECT word FROM f)) JOIN n ON contains(lower(name), word)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, distance, label, name) AS rank FROM a) SELECT word, rank, label, name, distance, score FROM r WHERE rank <= 3""", distance="BIGINT", rank="INT", score="DOUBLE")
def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every word of all documents, the three best names of five labels (parts, brands, types, suppliers, segments)
    with a term within two edits; for words near none, names that hold them."""
    label = lambda t, c, name: table(spark, sf_dir, t).select(F.lit(name).alias("label"), F.col(c).alias("name"))
    names = label("part", "p_name", "Part").unionByName(label("part", "p_brand", "Brand")).unionByName(label("part", "p_type", "Type")).unionByName(label("supplier", "s_name", "Supplier")).unionByName(label("customer", "c_mktsegment", "Segment"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(fuzzy.WORD), 0))).alias("word"))
    return fuzzy.lookup(names, words)


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"), F.json_object_keys("props").alias("k"))
    return rows.select("event_id", F.element_at("m", F.element_at("k", 1)).alias("first"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(md5(text), 1, 16) AS UBIGINT) AS VARCHAR) AS point FROM documents")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of vector points, as unsigned 64-bit numbers in decimal."""
    return table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(F.md5("text"), 1, 16), 16, 10).alias("point"))


@query("""SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as Markdown tables, each with the header."""
    line = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line"))))["line"].alias("lines"))
    return rows.select("n_regionkey", F.concat(F.lit("| name | key |\n| --- | --- |\n"), F.array_join("lines", "\n")).alias("markdown"))


@query(r"""WITH n AS (SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS name FROM pages) SELECT page_id, CASE WHEN t = '' THEN 'unknown source' ELSE t END AS title FROM (SELECT page_id,
lower(trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(.)\.[^.]*$', '\1'), '^\d{10,}-', ''), '^\[\d+\]', ''), '[\(_]\d{4}[\)]?$', ''), '_-', '  '), '\s+', ' ', 'g'))) AS t FROM n)""")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable titles from addresses."""
    path = F.element_at(F.split("url", r"\?"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(text.clean_title(path)).alias("title"))


@query(f"""SELECT conv_id, turn, concat_ws(' ', CASE WHEN regexp_matches(text, '(?i){conversation.SHORTER}') THEN 'Be brief.' END, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 10 THEN 'Answer in few words.' END, CASE WHEN contains(text, '?') THEN 'Answer the question first.' END) AS guidance FROM conversations""")
def style_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How to answer, from the signs of a message."""
    t = F.col("text")
    parts = [F.when(t.rlike("(?i)" + conversation.SHORTER), "Be brief."), F.when(conversation.words(t) < 10, "Answer in few words."), F.when(F.contains(t, F.lit("?")), "Answer the question first.")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", *parts).alias("guidance"))
