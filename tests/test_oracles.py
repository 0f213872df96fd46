"""Every registered query of the main library against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from rankpulse import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else str(round(x, 6))
        return str(x).removesuffix(" 00:00:00")

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
