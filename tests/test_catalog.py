"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from runweave import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(values):
    return sorted(tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
