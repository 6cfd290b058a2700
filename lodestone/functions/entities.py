"""Entities in text: labelled patterns with confidences, each name once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.matching import ascii_words

#: (label, pattern, confidence); a domain gives its own. Standards, licences and contacts by default.
KINDS = (
    ("Standard", r"\b(?:ASTM|ISO|EN|DIN|CSA)\s?[A-Z]?\d{2,5}(?:-\d+)?\b", 0.95),
    ("License", r"\b(?:MIT|Apache|BSD|GNU General Public) License\b", 0.9),
    ("Contact", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.85),
    ("Domain", r"\b[a-z0-9-]+\.(?:com|org|net)\b", 0.6),
)


def extracted(rows: DataFrame, id_col: str, text_col: str, kinds=KINDS) -> DataFrame:
    """(id, name, label, confidence) of all matches."""
    parts = [rows.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ascii_words(p)), 0)).alias("name"), F.lit(label).alias("label"), F.lit(c).alias("confidence")) for label, p, c in kinds]
    return reduce(DataFrame.unionByName, parts)


def deduplicated(found: DataFrame, id_col: str) -> DataFrame:
    """Each name of a label once a text, whatever its case: the surest, then the first by name."""
    rank = F.row_number().over(W.partitionBy(id_col, F.lower("name"), "label").orderBy(F.desc("confidence"), "name"))
    return found.withColumn("_n", rank).where("_n = 1").drop("_n")
