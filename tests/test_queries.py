"""Each query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from satchel.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (float, np.floating)) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 9)) if v != int(v) else str(int(v))
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(plain, r)) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, DATA).toPandas())
    assert got[1]
    assert got == rows(duck.sql(SQL[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
