"""Every registered query that has SQL gives what DuckDB gives (the engine's own at sf0.001)."""

import duckdb
import pytest

from barweave.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(plain(r[n]) for n in names) for r in df.collect())))
    cursor = duck.execute(ORACLE_SQL[name])
    own = [d[0] for d in cursor.description]
    want = sorted(map(repr, (tuple(plain(dict(zip(own, r))[n]) for n in names) for r in cursor.fetchall())))
    assert sorted(own) == names
    assert got == want


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v
