"""Every query equals its SQL twin, and none of them needs a cross join."""

import duckdb
import pytest

from check_oracle import TABLES, normal
from crawlspark.oracle import ORACLE
from crawlspark.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, db, name):
    found = QUERIES[name](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert normal(found.toPandas()) == normal(db.execute(ORACLE[name]).df())
