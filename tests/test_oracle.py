"""Every query with SQL against DuckDB, the others for rows, over the smallest tables."""

import os

import duckdb
import pytest

from weftlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf, duck):
    found = catalogue.queries()[name](spark, sf).toPandas()
    if sql := catalogue.oracle_sql().get(name):
        assert rows(found) == rows(duck.execute(sql).df())
    else:
        assert len(found.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_training_data_operators():
    top = os.path.join(os.path.dirname(catalogue.__file__), "..")
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "weftlake.llm" not in f.read(), n
