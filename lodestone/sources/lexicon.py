"""A domain's words and settings: defaults with a JSON file's entries over them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Lexicon:
    topics: list[str] = field(default_factory=lambda: ["general"])
    synonyms: list[list[str]] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    specialties: dict[str, list[str]] = field(default_factory=dict)
    variants: dict[str, list[str]] = field(default_factory=dict)


def load(spark: SparkSession, path: str | None) -> Lexicon:
    """Reads a lexicon by Spark, so that it may stand wherever tables do; unknown entries are left out."""
    if path is None:
        return Lexicon()
    text = "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())  # one small file
    given = json.loads(text)
    return Lexicon(**{k: v for k, v in given.items() if k in Lexicon.__dataclass_fields__ and v is not None})
