import duckdb
import pytest

import __spark_entry__ as contract
from ledgerfold.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_entry_and_names(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    rows = lambda data, names: sorted(repr([r[names.index(c)] for c in columns]) for r in data)
    want = rows(found.fetchall(), [c[0] for c in found.description])
    assert sorted(got.columns) == columns
    assert rows([tuple(r) for r in got.collect()], got.columns) == want
