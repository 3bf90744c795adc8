"""Every registered query that SQL can express agrees with its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from fathomline.plans import registry
from fathomline.session import ship

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, float):  # pandas turns columns of integers with nulls into floats
            return str(int(x)) if x == int(x) else f"{x:.6f}"
        return str(int(x)) if hasattr(x, "__int__") and not isinstance(x, str) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    ship(spark)
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(oracle.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)
