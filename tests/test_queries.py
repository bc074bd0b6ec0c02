"""Every registered series query: against its SQL in DuckDB where it has one, else that it runs."""

import duckdb
import pytest

from seriesloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    """Rows by their exact columns first, and these and the others of each."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [([str(r[i]) for i in order if not isinstance(r[i], float)], [r[i] for i in order if isinstance(r[i], float)]) for r in rows]
    return sorted(made)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = plain(got, df.columns), plain(want.fetchall(), want.columns)
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x[1] == pytest.approx(y[1], rel=1e-4, abs=1e-4)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
