import os

import duckdb
import pandas as pd
import pytest

from quern.plans import catalogue, identities, planning, routing, selection  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """Nulls as None, and whole numbers alike whether or not a column has nulls."""
    if x is None or x is pd.NA or x != x:
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


def shown(rows):
    return sorted(str(tuple(map(plain, r))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = duck.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got[columns].astype(object).values.tolist()) == shown(want[columns].astype(object).values.tolist())
