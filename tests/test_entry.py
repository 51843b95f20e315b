"""The registered queries against their SQL, on the small tables."""

import os

import __spark_entry__
import duckdb
import pytest
from lodestar.plans.oracle import ORACLE_SQL
from lodestar.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    got = [tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()]
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()]
    assert sorted(frame.columns) == sorted(names) and sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
