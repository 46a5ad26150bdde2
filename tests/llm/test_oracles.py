"""The training-data queries that SQL can express give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from runweave.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in "documents pages labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda values: sorted(tuple("null" if v is None else f"{v:.12g}" if isinstance(v, float) else str(v) for v in r) for r in values)
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(want.fetchall())
