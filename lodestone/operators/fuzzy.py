"""Names within an edit distance of asked words, as equi-joins.

Terms of names are indexed once. A short term by its deletion neighbourhood: itself and what is left after deleting up to
DISTANCE characters; words within the distance share one of these with it. A longer one is cut into DISTANCE + 1
segments, of which DISTANCE edits leave one whole; a word that is near has that segment at its place, or up to DISTANCE
places from it, for each length that the term may have. Keys are hashed with the kind of key; what meets is counted once
and checked by the distance itself. Names and words are compared in lower case. An asked word that is near no term is
looked up as a part of names, of which all parts are keys.

Null names and words meet nothing; a name repeated under a label is one. What an index holds grows with the names, not
with the texts that are asked.
Nothing is broadcast: Spark guesses what terms and keys take from the size of compressed files, of which they are many
times the size, and they would be built in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Edits; and the greatest length whose deletions are keys.
DISTANCE, SHORT = 2, 8
WORD = "[a-z0-9_]+"


def _without_one(word: Column) -> Column:
    """What deleting one character leaves; nothing of an empty word."""
    places = F.sequence(F.lit(1), F.length(word))
    return F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def deletions(word: Column, most: int = DISTANCE) -> Column:
    """The word and what is left of it after up to `most` deletions, each once."""
    found = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def _segment(length: Column, k: int, n: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment k of n of a term."""
    base, more = F.floor(length / n).cast("int"), (length % n).cast("int")
    own = base + F.when(F.lit(k) >= n - more, 1).otherwise(0)
    return base * k + F.greatest(F.lit(0), more - (n - F.lit(k))) + 1, own


def _term_keys(term: Column, most: int) -> Column:
    n = F.length(term)
    short = F.transform(deletions(term, most), lambda x: F.concat(F.lit("d:"), x))
    long = []
    for k in range(most + 1):
        start, size = _segment(n, k, most + 1)
        long.append(F.concat(F.lit(f"s{k}:"), n.cast("string"), F.lit(":"), F.substring(term, start, size)))
    return F.when(n <= SHORT, short).otherwise(F.array(*long))


def _word_keys(word: Column, most: int) -> Column:
    n = F.length(word)
    # a term of up to SHORT characters may be near a word of up to so many more
    short = F.when(n <= SHORT + most, F.transform(deletions(word, most), lambda x: F.concat(F.lit("d:"), x))).otherwise(F.array().cast("array<string>"))
    lengths = F.filter(F.sequence(n - most, n + most), lambda x: x > SHORT)

    def places(length: Column) -> Column:
        parts = []
        for k in range(most + 1):
            start, size = _segment(length, k, most + 1)
            at = F.filter(F.sequence(start - most, start + most), lambda p: (p >= 1) & (p + size - 1 <= n))
            parts.append(F.transform(at, lambda p: F.concat(F.lit(f"s{k}:"), length.cast("string"), F.lit(":"), F.substring(word, p, size))))
        return F.concat(*parts)

    return F.concat(short, F.array_distinct(F.flatten(F.transform(lengths, places))))


def near(terms: DataFrame, words: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(term, word, distance): all pairs of the columns `term` and `word` with a distance of up to `most`."""
    own = terms.select(F.lower("term").alias("term")).where("term is not null").distinct()
    asked = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    index = own.select("term", F.explode(_term_keys(F.col("term"), most)).alias("key"))
    looked = asked.select("word", F.explode(_word_keys(F.col("word"), most)).alias("key"))
    met = index.hint("merge").join(looked.hint("merge"), "key").where(F.abs(F.length("term") - F.length("word")) <= most).select("term", "word").distinct()
    return met.withColumn("distance", F.levenshtein("term", "word")).where(F.col("distance") <= most)


def held(names: DataFrame, words: DataFrame, least: int = 1) -> DataFrame:
    """(name, word): words of at least so many characters that a name holds as a part, whatever the case."""
    own = names.select("name", F.lower("name").alias("low")).where("low is not null").distinct()
    starts = own.select("name", "low", F.explode(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1)))).alias("at"))
    parts = starts.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("at") + 1), lambda n: F.substring(F.col("low"), F.col("at"), n))).alias("word"))
    asked = words.select(F.lower("word").alias("word")).where((F.col("word").isNotNull()) & (F.length("word") >= least)).distinct()
    return parts.where(F.length("word") >= least).distinct().hint("merge").join(asked.hint("merge"), "word").select("name", "word")


def lookup(names: DataFrame, words: DataFrame, top: int = 3, most: int = DISTANCE) -> DataFrame:
    """(word, rank, label, name, distance, score): for each asked word the `top` best of names (label, name) with a term that
    is near, by 1 - distance / the greater length; for words near none, names that hold them, with score 1."""
    names = names.select("label", "name").where("name is not null").distinct()
    terms = names.select("label", "name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(WORD), 0))).alias("term"))
    found = near(terms, words, most)
    score = 1 - F.col("distance") / F.greatest(F.length("term"), F.length("word"))
    fuzzy = found.hint("merge").join(terms.hint("merge"), "term").groupBy("word", "label", "name").agg(F.min("distance").cast("long").alias("distance"), F.round(F.max(score), 6).alias("score"))
    rest = words.select(F.lower("word").alias("word")).where("word is not null").distinct().join(found.select("word").distinct().hint("merge"), "word", "left_anti")
    part = held(names, rest).hint("merge").join(names.hint("merge"), "name").select("word", "label", "name", F.lit(-1).cast("long").alias("distance"), F.lit(1.0).alias("score"))
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("score"), "distance", "label", "name"))
    return fuzzy.unionByName(part).withColumn("rank", rank).where(F.col("rank") <= top).select("word", "rank", "label", "name", "distance", "score")
