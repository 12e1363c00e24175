"""Every registered query against DuckDB on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest

from loomspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_model_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 4
