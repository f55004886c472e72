import duckdb
import pytest

from evigraph import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns)
    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    theirs = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
