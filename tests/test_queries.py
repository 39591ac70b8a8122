"""Every registered study query against its SQL on DuckDB."""

import importlib.util

import duckdb
import numpy as np
import pandas as pd
import pytest

from pulsegrid.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) or x is pd.NA:
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.integer, np.floating)):
            return f"{float(x) + 0.0:.5f}"
        return str(x)

    return sorted(map(tuple, df[sorted(df.columns)].map(text).values.tolist()))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_point_works_with_and_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("pulsegrid.llm") is None:
        assert not [n for n in entry.queries() if n.startswith("op")]
    assert entry.entry(spark).count() > 0
