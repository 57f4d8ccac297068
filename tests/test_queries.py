"""Every query beside its SQL, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def bag(names, rows):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith(("op", "pipeline"))))
def test_query_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, df.collect()) == bag(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.queries() if k not in __spark_entry__.oracle_sql() and not k.startswith(("op", "pipeline"))))
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["metric", "day", "n", "avg_value", "min_value", "max_value", "unit"]


def test_order_lines_are_dealt_by_their_number(spark, monkeypatch):
    """A task has so many lines however few bytes they are, from the join with the orders on, and again where a query goes by the result's id."""
    from chartlode.plans import catalogue, views

    few = sorted(map(str, views.Tables(spark, str(DATA)).labs().collect()))
    wanted = {name: sorted(map(str, catalogue.QUERIES[name](spark, str(DATA)).collect())) for name in ("AGG-21", "SET-07", "SC-68", "DML-03")}
    monkeypatch.setattr(views, "LINES_A_TASK", 500)
    t = views.Tables(spark, str(DATA))
    assert t.tasks == -(-t.read("lineitem").count() // 500) > spark.sparkContext.defaultParallelism
    assert t.labs().rdd.getNumPartitions() == t.tasks and sorted(map(str, t.labs().collect())) == few
    for name, rows in wanted.items():
        out = catalogue.QUERIES[name](spark, str(DATA))
        assert f"numPartitions={t.tasks}" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) or f", {t.tasks}" in plan
        assert sorted(map(str, out.collect())) == rows


def test_results_of_names_read_the_order_lines_once(spark):
    """FLT-07's names and what they are asked for are found before."""
    plan = __spark_entry__.queries()["FLT-07"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" parquet") == 4  # lines, parts, orders and what was found
