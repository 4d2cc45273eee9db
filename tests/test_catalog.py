"""Registered queries against their SQL twins on the smallest tables."""

import math
import os

import duckdb
import pytest

from factorlake.catalog import load_all
from factorlake.sources import driver_views as V

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = [name for name, q in load_all().items() if q.sql is not None]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return None if v is None else str(v)[:19]


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", TWINS)
def test_query_matches_sql(spark, duck, name):
    q = load_all()[name]
    d = q.run(spark, SF)
    r = duck.execute(q.sql)
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(d.columns)
    assert table([tuple(x) for x in d.collect()], d.columns) == table(r.fetchall(), cols)


def test_every_query_has_a_description_of_what_it_covers():
    for name, q in load_all().items():
        assert q.covers, name


def plan_of(spark, name):
    return load_all()[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_trades_are_scanned_once_for_all_plans(spark):
    """The daily table is summed in one pass; evaluations read it bucketed and never the trades again."""
    days = V.daily(spark, SF)
    assert V.daily(spark, SF)._jdf.queryExecution().analyzed().toString() == days._jdf.queryExecution().analyzed().toString()
    assert days.count() == V.trades(spark, SF).select("ticker", "session").distinct().count()
    for name, exchanges in (("bar_returns", 0), ("evaluation_summary", 3), ("screen_top", 1), ("live_features", 1)):
        plan = plan_of(spark, name)
        assert "lineitem" not in plan and "daily_" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert plan.count("Exchange hashpartitioning") <= exchanges


def test_daily_table_follows_its_source(spark, tmp_path):
    rows = [(1, 1, 7, "1996-01-02", 1, "N", "O", 10.0, 1.0, 0.05, 0.0), (1, 2, 7, "1996-01-02", 2, "R", "F", 5.0, 2.0, 0.0, 0.01)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate string, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, schema).write.parquet(path)
    first = V.daily(spark, str(tmp_path)).collect()
    assert [(r["ext"], r["qty"], r["kept"], r["payments"], r["paid_pct"]) for r in first] == [(1500, 3, 1000, 1, 5)]
    os.utime(path, (1, 1))
    spark.createDataFrame(rows[:1], schema).write.mode("append").parquet(path)
    assert V.daily(spark, str(tmp_path)).collect()[0]["ext"] == 2500
