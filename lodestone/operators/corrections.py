"""Corrections that users give: merging firm and learned ones, and confidence as feedback moves it.

Merging is greedy in the order given, each row's fate depending on those kept before it: a fold over a session's array.
Confidence adds and subtracts within a floor and a cap. Such steps are functions x -> min(high, max(low, x + add)), and one
after another they are again such a function; so each span of time of a correction is folded apart, the spans are chained
in order, and every span is folded again from where it begins. A correction with very much feedback is many rows.

Confidences are whole hundredths, so that no sum depends on its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Most corrections of an answer, words in common that make two one; what feedback adds and takes, where a
# correction is given up (hundredths), and the seconds after an application in which feedback counts.
MOST, SHARED = 3, 3
BOOST, PENALTY, LEAST, LOOKBACK = 5, 15, 30, 300
START = 80


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def merged(firm: Column, learned: Column, most: int = MOST, shared: int = SHARED) -> Column:
    """The first `most` firm texts, then learned ones in order while there is room, but for those that have `shared` words or
    more in common with one kept before. Null arrays are empty; null texts are left out."""
    texts = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    same = lambda kept, x: F.exists(kept, lambda e: F.size(F.array_intersect(_words(e), _words(x))) >= shared)
    return F.aggregate(texts(learned), F.slice(texts(firm), 1, most), lambda kept, x: F.when((F.size(kept) >= most) | same(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def touched(applied: DataFrame, feedback: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(correction, feedback_id, ts, positive): corrections that each feedback moves: those applied in its session less than
    `lookback` seconds before it and after the session's last feedback. applied: session, correction, ts; feedback:
    session, feedback_id, ts, positive."""
    f = feedback.select("session", "ts", F.lit(0).alias("kind"), F.lit(None).cast(applied.schema["correction"].dataType).alias("correction"), F.struct("ts", F.col("feedback_id").alias("id"), "positive").alias("said"))
    a = applied.select("session", "ts", F.lit(1).alias("kind"), "correction", F.lit(None).cast(f.schema["said"].dataType).alias("said"))
    # from the last row backwards, so that the next feedback is one that was seen
    order = W.partitionBy("session").orderBy(F.desc("ts"), "kind", F.desc("said.id")).rowsBetween(W.unboundedPreceding, 0)
    rows = a.unionByName(f).withColumn("next", F.last("said", True).over(order)).where("kind = 1 and next is not null")
    near = rows.where(F.col("next.ts") < F.col("ts") + F.make_dt_interval(secs=F.lit(lookback)))
    return near.select("correction", F.col("next.id").alias("feedback_id"), F.col("next.ts").alias("ts"), F.col("next.positive").alias("positive")).distinct()


def _clamped(x: Column, positive: Column) -> Column:
    return F.when(positive, F.least(F.lit(100), x + BOOST)).otherwise(F.greatest(F.lit(0), x - PENALTY)).cast("int")


def confidences(moves: DataFrame, span: Column, start: int = START) -> DataFrame:
    """(correction, feedback_id, ts, confidence, active): after each feedback of moves (correction, feedback_id, ts, positive), in
    order of ts and id. A correction that negative feedback brought under LEAST isn't active from there on. span: what cuts
    time into spans, rising with ts."""
    own = F.array_sort(F.collect_list(F.struct("ts", "feedback_id", "positive")))
    spans = moves.groupBy("correction", span.alias("span")).agg(own.alias("own"))
    far = 1 << 20
    step = lambda s, x: F.struct((s["add"] + F.when(x["positive"], BOOST).otherwise(-PENALTY)).cast("int").alias("add"), _clamped(s["low"], x["positive"]).alias("low"), _clamped(s["high"], x["positive"]).alias("high"))
    whole = F.aggregate("own", F.struct(F.lit(0).alias("add"), F.lit(-far).alias("low"), F.lit(far).alias("high")), step)
    spans = spans.withColumn("whole", whole)
    # a correction's spans, of which there are as many as days, say, whatever is said on each
    chained = F.aggregate(
        F.array_sort(F.collect_list(F.struct("span", "whole"))), F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct(F.least(x["whole"]["high"], F.greatest(x["whole"]["low"], s["at"] + x["whole"]["add"])).cast("int").alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"],
    )
    starts = spans.groupBy("correction").agg(chained.alias("starts"), F.array_sort(F.collect_list("span")).alias("spans")).select("correction", F.explode(F.arrays_zip("spans", "starts")).alias("x"))
    starts = starts.select(F.col("correction").alias("of"), F.col("x.spans").alias("begins"), F.col("x.starts").alias("start"))
    met = spans.join(starts, (F.col("correction") == F.col("of")) & (F.col("span") == F.col("begins")))
    run = F.aggregate(
        "own", F.struct(F.col("start").alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct(_clamped(s["at"], x["positive"]).alias("at"), F.concat(s["out"], F.array(_clamped(s["at"], x["positive"]))).alias("out")), lambda s: s["out"],
    )
    rows = met.select("correction", F.explode(F.arrays_zip("own", run.alias("value"))).alias("x")).select("correction", "x.own.ts", "x.own.feedback_id", "x.own.positive", "x.value")
    given_up = rows.where((F.col("value") < LEAST) & ~F.col("positive")).groupBy(F.col("correction").alias("of")).agg(F.min(F.struct("ts", "feedback_id")).alias("end"))
    rows = rows.join(given_up, F.col("correction") == F.col("of"), "left")
    active = F.col("end").isNull() | (F.struct("ts", "feedback_id") < F.col("end"))
    return rows.select("correction", "feedback_id", "ts", F.round(F.col("value") / 100, 2).alias("confidence"), active.alias("active"))
