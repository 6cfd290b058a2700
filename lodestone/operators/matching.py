"""Matches of a pattern with their places in the text, by expressions of the JVM alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a word of ASCII begins or ends: what SQL means by \b (to the JVM letters of any script are parts of words).
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_words(pattern: str) -> str:
    r"""The pattern with words as SQL sees them at each \b."""
    return pattern.replace(r"\b", BOUNDARY)


def positions(rows: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """(id, found, at): every match and its offset in characters. The text between the matches is what splitting leaves."""
    pattern = ascii_words(pattern)
    parts = rows.select(id_col, F.split(text_col, pattern).alias("rest"), F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0).alias("found"))
    flat = parts.select(id_col, F.posexplode("found").alias("i", "found"), "rest", F.col("found").alias("all"))
    before = F.aggregate(F.slice("rest", 1, F.col("i") + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("all", 1, F.col("i")), F.lit(0), lambda s, x: s + F.length(x))
    return flat.select(id_col, "found", before.alias("at"))
