"""Every registered query of the library on the smallest data, held against its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as e
from voxframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got
    if name in registry.ORACLE:
        r = duck.execute(registry.ORACLE[name])
        names = [d[0] for d in r.description]
        want = sorted((tuple(row[names.index(c)] for c in cols) for row in r.fetchall()), key=str)
        assert sorted(names) == cols and got == want
