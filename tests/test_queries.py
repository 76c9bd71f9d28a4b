"""Every registered statement against DuckDB, and random conditions against it."""

import glob
import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tamarack import queries
from tamarack.engine import Engine

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def held(found, want):
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(found) == text(want)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    result = duck.execute(queries.oracles()[name])
    assert df.columns == [c[0] for c in result.description]
    held(df.collect(), result.fetchall())


_value = st.one_of(st.sampled_from(["p_size", "p_partkey"]), st.integers(0, 60).map(str))
_sum = st.tuples(_value, st.sampled_from("+-*"), _value).map(" ".join)
_test = st.tuples(st.one_of(_value, _sum), st.sampled_from(["<", ">", "<=", ">=", "=", "!="]), st.one_of(_value, _sum)).map(" ".join)
_condition = st.recursive(_test, lambda c: st.tuples(c, st.sampled_from(["AND", "OR"]), c).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_condition)
def test_random_conditions(spark, duck, condition):
    found = Engine(spark, DIR).sql(f'SELECT p_partkey FROM "part" p WHERE {condition}').collect()
    held(found, duck.execute(f"select p_partkey from part where {condition}").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_statement_may_stream(spark, tmp_path):
    from tamarack.streaming import follow

    spark.range(5).selectExpr("id", "id * 2 AS twice").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    query = follow(engine, 'SELECT id + 1 AS k FROM "numbers" n WHERE twice >= 4', "numbers", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4, 5]
