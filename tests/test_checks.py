import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_ranked_clusters(spark):
    rows = entry.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 24))
    assert sum(r["crashes"] for r in rows) == 5798


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(r[c] for c in columns)) for r in df.collect()))
    cursor = engine.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())
    assert got == want
