"""Every registered query against its SQL in DuckDB; those without SQL, on the smallest tables, must give rows."""

import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The tables that queries are held to their SQL on.
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        if float(v) == round(float(v)):  # whole numbers are compared exactly
            return str(int(v))
        return f"{float(v):.5g}"
    except (TypeError, ValueError, OverflowError):
        return str(v)


def rows(frame):
    """Columns by name, and rows in the order of what is shown of them, each with its values."""
    frame = frame[sorted(frame.columns)]
    own = lambda r: tuple(float(v) if number(v) else 0.0 for v in r)
    return list(frame.columns), sorted(((tuple(map(shown, r)), tuple(r)) for r in frame.itertuples(index=False)), key=lambda x: (x[0], own(x[1])))


def number(v):
    return isinstance(v, (int, float, decimal.Decimal, np.number)) and not isinstance(v, (bool, np.bool_)) and not math.isnan(v)


def same(a, b):
    """Whether two values are shown alike or, if they are numbers, are equal but for a millionth, as sums in another order are."""
    if number(a) and number(b):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    return shown(a) == shown(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    found = QUERIES[name](spark, FOLDER if name in ORACLES else data).toPandas()
    if name in ORACLES:
        columns, got = rows(found)
        names, want = rows(duck.execute(ORACLES[name]).df())
        assert columns == names and len(got) == len(want)
        for (_, a), (_, b) in zip(got, want):
            assert all(map(same, a, b)), (a, b)
    else:
        assert len(found)


def test_entry_imports_without_training_data_folder(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLES)
