"""Every registered query equals its DuckDB oracle on the smallest driver tables."""
import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import canon, same
from conftest import SF
from tillroll.plans.oracle import ORACLE
from tillroll.plans.registry import QUERIES
from tillroll.sources.tables import TABLE_NAMES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["branch", "shift", "mean_staff", "max_staff", "min_staff",
                          "days_observed", "recommended_staff"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLE[name])
    types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == types
    res = con.execute(ORACLE[name])
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(got_cols) == sorted(want_cols)
    assert len(got) == len(want)
    assert same(canon(got_cols, got), canon(want_cols, want))


def test_every_query_is_documented():
    import os
    readme = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "README.md")).read()
    assert [k for k in QUERIES if f"`{k}`" not in readme] == []
