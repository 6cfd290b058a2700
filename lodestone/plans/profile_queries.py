"""Queries of the conversation, event, quality and privacy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import conversation as c
from lodestone.functions import privacy
from lodestone.operators import quality, sessions
from lodestone.registry import query, table


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(column: str, patterns) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({column}, {_sql('(?i)' + p)}) AS INT)" for p in patterns) + ")"


def _first(column: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_sql('(?i)' + p)}) THEN '{v}'" for p, v in patterns) + " END"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


_MESSAGES = "m AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
_NUMBER_OF_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {_MESSAGES}, f AS (SELECT conv_id, turn, {_NUMBER_OF_WORDS} AS words, {_count("text", c.CASUAL)} AS ca, {_count("text", c.FORMAL)} AS fo, {_count("text", c.URGENT)} AS ur, {_count("text", c.TECHNICAL)} AS te FROM m),
g AS (SELECT *, CASE WHEN ca + fo > 0 THEN (fo - ca) / (ca + fo) ELSE 0.0 END AS formality FROM f),
w AS (SELECT *, avg(words) OVER o AS mean_words, avg(formality) OVER o AS mean_formality, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM g WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, n, round(mean_words, 6) AS mean_words, CASE WHEN mean_words < 10 THEN 'terse' WHEN mean_words > 50 THEN 'verbose' ELSE 'normal' END AS brevity,
 CASE WHEN mean_formality < -0.3 THEN 'casual' WHEN mean_formality > 0.3 THEN 'formal' ELSE 'neutral' END AS style, CASE WHEN ur >= 2 THEN 'urgent' WHEN ur = 1 THEN 'normal' ELSE 'relaxed' END AS urgency, round(least(1.0, te / 5.0), 6) AS depth FROM w""")
def energy_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brevity and style over a session's last ten messages, urgency and depth of each."""
    by = W.partitionBy("conv_id").orderBy("turn")
    rows = _messages(spark, sf_dir).select("conv_id", "turn", c.words(F.col("text")).alias("words"), c.formality(F.col("text")).alias("formality"), c.urgency(F.col("text")).alias("urgency"), F.round(c.technical_depth(F.col("text")), 6).alias("depth"))
    rows = rows.select("*", F.avg("words").over(by.rowsBetween(-9, 0)).alias("mean"), F.avg("formality").over(by.rowsBetween(-9, 0)).alias("f"), F.row_number().over(by).alias("n"))
    brevity = F.when(F.col("mean") < 10, "terse").when(F.col("mean") > 50, "verbose").otherwise("normal")
    style = F.when(F.col("f") < -0.3, "casual").when(F.col("f") > 0.3, "formal").otherwise("neutral")
    return rows.select("conv_id", "turn", "n", F.round("mean", 6).alias("mean_words"), brevity.alias("brevity"), style.alias("style"), "urgency", "depth")


@query(f"""WITH {_MESSAGES}, f AS (SELECT conv_id, turn, least(1.0, {_count("text", c.TECHNICAL)} / 5.0) AS depth, {", ".join(f'CAST({_count("text", p)} > 0 AS INT) AS {k}' for k, p in c.LEVELS.items())} FROM m),
s AS (SELECT conv_id, turn, depth, sum(junior) OVER o AS junior, sum(senior) OVER o AS senior, sum(management) OVER o AS management FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CASE WHEN senior > 0 AND junior > 0 THEN senior * 2 ELSE senior END AS se, CASE WHEN depth < 0.05 THEN 'junior' WHEN depth > 0.5 THEN 'senior' ELSE 'intermediate' END AS base FROM s),
u AS (SELECT *, greatest(junior, se, management) AS most FROM t)
SELECT conv_id, turn, junior, senior, management, CASE WHEN most >= 3 AND management = most THEN 'management' WHEN most >= 3 AND se = most THEN 'senior' WHEN most >= 3 THEN 'junior' WHEN most = 1 AND management = 1 THEN 'management'
 WHEN most = 1 AND se = 1 AND base <> 'junior' THEN 'senior' WHEN most = 1 AND junior = 1 AND base = 'junior' THEN 'junior' ELSE base END AS level FROM u""", junior="BIGINT", senior="BIGINT", management="BIGINT")
def expertise_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of expertise so far in a session and the level that they give."""
    text = F.col("text")
    rows = _messages(spark, sf_dir).select("conv_id", "turn", c.technical_depth(text).alias("depth"), *(c.shows(text, k).alias(k) for k in c.LEVELS))
    rows = sessions.running(rows, "conv_id", "turn", list(c.LEVELS))
    so_far = [F.col(f"{k}_so_far") for k in c.LEVELS]
    return rows.select("conv_id", "turn", *(x.alias(k) for x, k in zip(so_far, c.LEVELS)), c.expertise(F.col("depth"), *so_far).alias("level"))


@query(f"""WITH {_MESSAGES}, f AS (SELECT conv_id, turn, {_first("text", tuple(reversed(c.FORMATS)))} AS form, {_first("text", tuple(reversed(c.UNITS)))} AS unit FROM m)
SELECT conv_id, turn, last_value(form IGNORE NULLS) OVER o AS form, last_value(unit IGNORE NULLS) OVER o AS unit FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def preference_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format and units last asked for."""
    by = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = _messages(spark, sf_dir).select("conv_id", "turn", c.last_match(F.col("text"), c.FORMATS).alias("form"), c.last_match(F.col("text"), c.UNITS).alias("unit"))
    return rows.select("conv_id", "turn", F.last("form", True).over(by).alias("form"), F.last("unit", True).over(by).alias("unit"))


@query(f"""WITH RECURSIVE {_MESSAGES}, f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN {_NUMBER_OF_WORDS} > 60 THEN -0.3 WHEN {_NUMBER_OF_WORDS} < 25 THEN 0.3 ELSE 0.0 END
 + CASE WHEN {_count("text", [c.SHORTER])} > 0 THEN -0.3 ELSE 0.0 END + CASE WHEN {_count("text", [c.LONGER])} > 0 THEN 0.3 ELSE 0.0 END AS step FROM m),
r AS (SELECT conv_id, 0 AS n, CAST(0.0 AS DOUBLE) AS v FROM f GROUP BY conv_id UNION ALL SELECT f.conv_id, f.n, greatest(-1.0, least(1.0, r.v + f.step)) FROM r JOIN f ON f.conv_id = r.conv_id AND f.n = r.n + 1)
SELECT conv_id, round(arg_max(v, n), 6) AS verbosity FROM r GROUP BY conv_id""")
def preference_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's wish for length, held between -1 and 1 at each message (long messages count as a wish for
    short answers here, short ones for long)."""
    n, text = c.words(F.col("text")), F.col("text")
    signs = F.when(text.rlike("(?i)" + c.SHORTER), -0.3).otherwise(0.0) + F.when(text.rlike("(?i)" + c.LONGER), 0.3).otherwise(0.0)
    rows = _messages(spark, sf_dir).select("conv_id", "turn", (F.when(n > 60, -0.3).when(n < 25, 0.3).otherwise(0.0) + signs).alias("step"))
    steps = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "step"))).alias("s"))
    return steps.select("conv_id", F.round(sessions.clamped_sum(F.col("s.step")), 6).alias("verbosity"))


@query(f"SELECT conv_id, turn, {_first('text', [(p, 'negative') for p in c.NEGATIVE] + [(p, 'positive') for p in c.POSITIVE])} AS cue, {_first('text', c.ACTIONS)} AS action FROM conversations")
def feedback_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback that a message implies, and the action that it asks for."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.feedback(F.col("text")).alias("cue"), c.first_match(F.col("text"), c.ACTIONS).alias("action"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, {_sql('(?i)' + p)}) THEN {i}" for i, (p, _) in enumerate(c.CORRECTIONS)) + " END"
_SURE = "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(c.CORRECTIONS)) + " END"


@query(f"""WITH k AS (SELECT conv_id, turn, {_KIND} AS kind, list_sort(list_filter({list(c.CONTEXT_WORDS)}, lambda w: contains(lower(text), w)))[1:10] AS words FROM conversations)
SELECT conv_id, turn, kind, {_SURE} AS confidence, array_to_string(words, ',') AS words FROM k WHERE kind IS NOT NULL""", confidence="DOUBLE")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that correct an answer, which pattern shows it, how surely, and up to ten words of context."""
    numbered = [(p, i) for i, (p, _) in enumerate(c.CORRECTIONS)]
    words = F.slice(F.array_sort(F.filter(F.array(*map(F.lit, c.CONTEXT_WORDS)), lambda w: F.contains(F.lower("text"), w))), 1, 10)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", c.first_match(F.col("text"), numbered).alias("kind"), words.alias("words")).where("kind is not null")
    sure = F.element_at(F.array(*(F.lit(v) for _, v in c.CORRECTIONS)), F.col("kind") + 1)
    return rows.select("conv_id", "turn", "kind", sure.alias("confidence"), F.array_join("words", ",").alias("words"))


_Q = "lower(trim(text))"


@query(f"""WITH k AS (SELECT item_id, {_Q} AS t, {_count(_Q, c.CROSS)} AS x, {_count(_Q, c.GLOBAL)} AS g, {_count(_Q, c.LOCAL)} AS l, {_NUMBER_OF_WORDS} AS n FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents))
SELECT item_id, n, CASE WHEN x > 0 THEN 'cross_ref' WHEN g + l = 0 THEN CASE WHEN n <= 3 THEN 'hybrid' WHEN starts_with(t, 'what are') OR starts_with(t, 'how do') OR starts_with(t, 'why') THEN 'global' WHEN starts_with(t, 'what is') AND n <= 6 THEN 'local' WHEN n >= 10 THEN 'local' ELSE 'hybrid' END
 WHEN g > l THEN 'global' WHEN l > g THEN 'local' ELSE 'hybrid' END AS kind, round(CASE WHEN x > 0 THEN least(0.95, 0.5 + x * 0.2) WHEN g + l = 0 THEN 0.5 WHEN g > l THEN least(0.95, g / (g + l + 1) + 0.3) WHEN l > g THEN least(0.95, l / (g + l + 1) + 0.3) ELSE 0.6 END, 6) AS confidence FROM k""")
def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q01, Q02, Q03, Q07: classes of texts taken as questions."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    rows = asked.select("item_id", c.words(F.col("text")).alias("n"), c.question_class(F.col("text")).alias("k"))
    return rows.select("item_id", "n", "k.kind", "k.confidence")


_ACTIONS = "a AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS next FROM events), t AS (SELECT previous, next, count(*) AS n FROM a WHERE previous IS NOT NULL GROUP BY previous, next)"


@query(f"WITH {_ACTIONS} SELECT previous, next, n FROM t")
def action_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an action follows another in a user's log."""
    return sessions.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {_ACTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY previous ORDER BY n DESC, next) AS k FROM t), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY previous), 6) AS share FROM r WHERE k <= 3) SELECT previous, next, n, share FROM s WHERE k = 1 AND share >= 0.3")
def next_action_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest next action, with its share of the three likeliest (0.3 or more here)."""
    return sessions.likely_next(action_transitions(spark, sf_dir), least=0.3)


_SESSIONS = """e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm FROM events), g AS (SELECT *, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS idle FROM e),
n AS (SELECT *, sum(CASE WHEN idle IS NULL OR idle > {0} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)"""


@query(f"WITH {_SESSIONS.format(86400)} SELECT user_id, session_no, count(*) AS n, round(max(tm) - min(tm), 3) AS seconds FROM n GROUP BY user_id, session_no", session_no="BIGINT")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after a day without access."""
    rows = sessions.sessions(table(spark, sf_dir, "events"), "user_id", F.col("ts"), 86400, "event_id")
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.round(F.max("at") - F.min("at"), 3).alias("seconds"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, tm AS start, 1 AS count FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.k, CASE WHEN e.tm - r.start >= 86400 THEN e.tm ELSE r.start END, CASE WHEN e.tm - r.start >= 86400 THEN 1 ELSE r.count + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, count, count <= 2 AS allowed FROM r""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events allowed under two a day and user, where a window starts with its first event."""
    return sessions.rate_limited(table(spark, sf_dir, "events"), "user_id", F.col("ts"), "event_id", 2, 86400)


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean, count(*) AS n, stddev_samp(value) AS sd FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, n, round(mean, 6) AS mean, v[n // 2 + 1] AS p50, v[CAST(floor(0.95 * n) AS BIGINT) + 1] AS p95, v[n] AS most, round(greatest(0.0, mean - CASE WHEN n < 30 THEN 2.0 ELSE 1.96 END * sd / sqrt(n)), 6) AS low, round(sd / mean, 6) AS cv FROM s""")
def latency_index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by index in order, spread and bounds of a measure, by kind of event."""
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value")
    sums = rows.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("value").alias("most"))
    picks = quality.at_ranks(rows, "event_type", ["value"], {"p50": F.floor(F.col("n") / 2), "p95": F.floor(0.95 * F.col("n"))})
    margin = F.when(F.col("n") < 30, 2.0).otherwise(1.96) * F.col("sd") / F.sqrt("n")
    return sums.join(picks, "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), "p50", "p95", "most", F.round(F.greatest(F.lit(0.0), F.col("mean") - margin), 6).alias("low"), F.round(F.col("sd") / F.col("mean"), 6).alias("cv"))


@query("""WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT user_id, max(day) AS last FROM d GROUP BY user_id)
SELECT d.user_id, round(avg(v) FILTER (WHERE day = last), 6) AS session, round(avg(v) FILTER (WHERE day < last), 6) AS profile, round(CASE WHEN avg(v) FILTER (WHERE day < last) IS NULL THEN avg(v) FILTER (WHERE day = last) ELSE 0.3 * avg(v) FILTER (WHERE day = last) + 0.7 * avg(v) FILTER (WHERE day < last) END, 5) AS blended
FROM d JOIN m ON d.user_id = m.user_id GROUP BY d.user_id""")
def profile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's profile after the last day's session, three tenths of which are new."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    days = days.withColumn("last", F.max("day").over(W.partitionBy("user_id")))
    new, old = F.avg(F.when(F.col("day") == F.col("last"), F.col("v"))), F.avg(F.when(F.col("day") < F.col("last"), F.col("v")))
    rows = days.groupBy("user_id").agg(new.alias("new"), old.alias("old"))
    return rows.select("user_id", F.round("new", 6).alias("session"), F.round("old", 6).alias("profile"), F.round(sessions.blended(F.col("old"), F.col("new")), 5).alias("blended"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS flagged, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS last_day, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of a log by kind, with those of its last day."""
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").alias("newest"))
    rows = rows.crossJoin(F.broadcast(newest))  # one row
    recent = F.col("ts") >= F.col("newest") - F.expr("INTERVAL 1 DAY")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("flagged"), F.count_if(recent).alias("last_day"), F.count_distinct("user_id").alias("users"))


_FLAGS = """p AS (SELECT source, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM documents),
f AS (SELECT source, CAST(length(bare) < 50 AS INT) AS empty, CAST(regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS INT) AS control, length(text) - length(translate(text, '�□■●◆▪▫◊○', '')) AS garbled, length(text) AS chars, len(string_split(text, chr(10))) AS lines,
 CAST(bare <> '' AND NOT contains('.!?"'')]}', right(bare, 1)) AND regexp_matches(regexp_extract(bare, '(\\S+)$', 1), '[\\p{L}\\p{N}]$') AND length(regexp_extract(bare, '(\\S+)$', 1)) >= 3 AS INT) AS cut,
 CAST(regexp_matches(text, '(?:\\|\\s*\\|\\s*\\|)|(?:(\\d+\\s+){5,})|(?:[-+|]{10,})') AS INT) AS tab FROM p),
s AS (SELECT source, count(*) AS pages, sum(empty) AS empty, sum(control) AS control, sum(garbled) AS garbled, sum(chars) AS chars, sum(lines) AS lines, sum(cut) AS cut, sum(tab) AS tab FROM f GROUP BY source),
l AS (SELECT source, trim(line) AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 10),
ln AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line),
rep AS (SELECT ln.source, count(*) AS repeated, sum(n) AS total FROM ln JOIN s ON ln.source = s.source WHERE n > greatest(3.0, pages * 0.3) GROUP BY ln.source),
c AS (SELECT s.source, pages, chars, CASE WHEN empty / pages > 0.5 THEN 'critical' WHEN empty / pages > 0.2 THEN 'high' WHEN empty > 0 THEN 'medium' END AS empty_pages, CASE WHEN control > 0 THEN 'high' END AS encoding,
 CASE WHEN garbled / chars > 0.1 THEN 'critical' WHEN garbled / chars > 0.02 THEN 'high' END AS garbled_text, CASE WHEN coalesce(total, 0) / lines >= 0.2 THEN 'high' WHEN coalesce(total, 0) / lines > 0.1 THEN 'medium' END AS repeated_content,
 CASE WHEN cut / pages > 0.3 THEN 'medium' END AS truncation, CASE WHEN tab > 0 THEN 'low' END AS table_artifacts FROM s LEFT JOIN rep ON rep.source = s.source)"""
_CHECKS = ("empty_pages", "encoding", "garbled_text", "repeated_content", "truncation", "table_artifacts")
_POINTS = " + ".join(f"CASE {k} WHEN 'critical' THEN 30 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END" for k in _CHECKS)
_OF = lambda s: "(" + " + ".join(f"CAST(coalesce({k} = '{s}', false) AS INT)" for k in _CHECKS) + ")"


@query(f"""WITH {_FLAGS}, w AS (SELECT *, CAST(least(100, {_POINTS} + CASE WHEN chars / pages < 50 THEN 20 ELSE 0 END) AS BIGINT) AS weirdness FROM c)
SELECT source, pages, {", ".join(_CHECKS)}, weirdness, weirdness >= 55 OR {_OF("critical")} > 0 OR {_OF("high")} >= 3 AS escalate FROM w""")
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of extracted text; a source is a document, its rows are pages."""
    return quality.report(table(spark, sf_dir, "documents"), "source", "text")


@query(f"""WITH {_FLAGS}, r AS (SELECT s.source, chars / pages AS density, garbled / chars AS garble, control > 0 AS control, empty / pages > 0.5 AS scanned, tab > 0 AS tab, coalesce(repeated, 0) AS repeated FROM s LEFT JOIN rep ON rep.source = s.source),
q AS (SELECT source, tab, greatest(0, least(100, 100 - CASE WHEN density < 500 THEN 40 WHEN density < 1000 THEN 20 WHEN density < 2000 THEN 10 ELSE 0 END - CASE WHEN garble > 0.1 THEN 50 WHEN garble > 0.05 THEN 30 WHEN garble > 0.01 THEN 15 ELSE 0 END
 - CASE WHEN control THEN 20 ELSE 0 END - CASE WHEN scanned THEN 25 ELSE 0 END - CASE WHEN tab THEN 5 ELSE 0 END - CASE WHEN repeated > 10 THEN 15 WHEN repeated > 5 THEN 8 ELSE 0 END)) AS score FROM r),
t AS (SELECT *, CASE WHEN score > 80 THEN 'high' WHEN score > 50 THEN 'medium' WHEN score > 20 THEN 'low' ELSE 'terrible' END AS tier FROM q)
SELECT source, CAST(score AS BIGINT) AS score, tier, CASE WHEN tier = 'high' AND NOT tab THEN 'text' WHEN tier IN ('high', 'medium') THEN 'layout' WHEN tier = 'low' THEN 'model' ELSE 'vision' END AS extractor FROM t""")
def scout_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, tier and extractor of each source."""
    pages = table(spark, sf_dir, "documents")
    flags = quality.page_flags(F.col("text"))
    s = pages.select("source", *(x.cast("long").alias(k) for k, x in flags.items())).groupBy("source").agg(F.count("*").alias("pages"), *(F.sum(k).alias(k) for k in flags))
    s = s.join(quality.repeated_lines(pages, "source", "text"), "source", "left").na.fill(0, ["repeated"])
    tab = F.col("table") > 0
    score = quality.quality_score(F.col("chars") / F.col("pages"), F.col("garbled") / F.col("chars"), F.col("control") > 0, F.col("empty") / F.col("pages") > 0.5, tab, F.lit(False), F.col("repeated"))
    s = s.select("source", score.cast("long").alias("score"), tab.alias("tab")).withColumn("tier", quality.tier(F.col("score")))
    return s.select("source", "score", "tier", quality.extractor(F.col("tier"), F.col("tab")).alias("extractor"))


@query("""WITH k AS (SELECT doc_id, CASE WHEN n_chars >= 5000 THEN 'large' WHEN n_chars >= 2000 THEN 'middle' ELSE 'small' END AS class FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pick FROM k) SELECT class, pick, doc_id FROM r WHERE pick <= 20""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of twenty documents of each size class."""
    return quality.stratified(table(spark, sf_dir, "documents"), F.col("n_chars"), (2000, 5000), 20, "doc_id").select("class", "pick", "doc_id")


#: Detectors that start with digits or address characters: for these the word boundaries of the JVM, which know all letters,
#: and those of SQL, which know ASCII, agree. The others, and what is redacted by all, are held by tests.
_PLAIN = ("email", "phone", "coordinates", "sin_ssn")
_DETECT = ", ".join(f"len(regexp_extract_all(text, {_sql('(?i)' + privacy.DETECTORS[k])})) AS {k}" for k in _PLAIN)


@query(f"SELECT doc_id, {_DETECT} FROM documents")
def pii_regex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each detector finds in a document."""
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(privacy.found(F.col("text"), k)).alias(k) for k in _PLAIN))


@query()
def pii_number_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates, project and file numbers, and names behind titles."""
    text = F.col("text")
    rest = [k for k in privacy.DETECTORS if k not in _PLAIN]
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(privacy.found(text, k)).alias(k) for k in rest), F.size(privacy.names(text)).alias("titled"))


@query()
def pii_redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with placeholders for what the detectors find."""
    out = privacy.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), F.length(out).alias("n"))


@query(f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, {_sql('(?i)' + privacy.DETECTORS['email'])})) AS found FROM documents)
SELECT lower(found) AS entity, count(*) AS n, min(doc_id) AS first_doc FROM x GROUP BY 1""")
def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address once, whatever its case."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.found(F.col("text"), "email")).alias("found"))
    return rows.groupBy(F.lower("found").alias("entity")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
