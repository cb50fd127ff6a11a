"""Every query with an SQL counterpart gives the same rows on the smallest tables."""

import duckdb
import pytest

from compare import TABLES, canonical
from quernstone import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_optimal_partitions_never_cost_more(spark):
    rows = catalog.QUERIES["vs_partitions_opt"](spark, FOLDER)
    assert rows.where("optimal_bits > greedy_bits").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
