"""Named queries over a folder of Parquet tables, each with the SQL that it must agree with where SQL can express it.

A query is a function of (spark, folder) that returns a DataFrame: the operators of this package applied to whole
tables. `query` registers it, with its SQL as one string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **casts: str) -> Callable[[Query], Query]:
    """casts: types of columns for which SQL has wider ones (sums of whole numbers, decimal literals)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            own = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in casts.items())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({own}) FROM ({sql})" if casts else sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_list(words) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
