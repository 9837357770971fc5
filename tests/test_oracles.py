"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

from paneltide.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def canonical(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(df[cols].notna(), None)
    return df.map(lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).sort_values(cols).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracles()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = canonical(mine), canonical(theirs)
    assert len(a) == len(b)
    assert (a == b).all().all(), a[(a != b).any(axis=1)].head().to_string()
