"""Each registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from pairloom.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def shown(df):
    text = df.map(lambda v: "" if v is None or v != v else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v))
    return sorted(map(tuple, text[sorted(df.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
