import duckdb
import pytest

from turfspark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = Q.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want and want
