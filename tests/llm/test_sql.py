"""Queries that SQL can express, against that SQL."""

import duckdb
import pytest

from ledgerfold.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    rows = lambda data, names: sorted(repr([r[names.index(c)] for c in columns]) for r in data)
    assert sorted(got.columns) == columns
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(found.fetchall(), [c[0] for c in found.description])
