"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from turfspark.plans import queries as P

TABLES = "region nation customer supplier part orders lineitem events pages".split()
SQL = P.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    df = P.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(_cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want and got


def test_every_query_has_sql():
    assert set(P.queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())
