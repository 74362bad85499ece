"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from echotrace.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return v.item() if isinstance(v, np.generic) else v


def table(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = table(QUERIES[name](spark, str(SF)).toPandas()), table(duck.execute(ORACLE_SQL[name]).fetch_df())
    assert got == want and got[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_entry_imports_without_the_training_data_operators():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
