"""Every query that has SQL, against DuckDB on a small table."""

import collections

import duckdb
import pytest

from quarry.plans import registry as queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return round(float(value), 6) if hasattr(value, "as_tuple") else value


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    relation = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in relation.description]
    assert sorted(names) == sorted(frame.columns)
    wanted = collections.Counter(tuple(plain(row[names.index(c)]) for c in frame.columns) for row in relation.fetchall())
    assert collections.Counter(tuple(map(plain, row)) for row in frame.collect()) == wanted


def test_all_have_sql():
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()
