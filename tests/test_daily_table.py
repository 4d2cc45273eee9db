"""The daily table of the driver views: how often trades move, and hot tickers."""

import os

import pytest

from factorlake.sources import driver_views as V

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")


def test_trades_move_once_and_narrow(spark):
    """One exchange, by ticker, below both parts of the sum: seven narrow columns instead of twelve wide sums, twice."""
    days = V._daily_sums(V._marked(V.trades(spark, SF)), 4)
    plan = days._jdf.queryExecution().sparkPlan().toString()
    lines = [x for x in days.repartition(4, "ticker")._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert len(lines) == 1 and "hashpartitioning(ticker" in lines[0] and "session" not in lines[0].split("hashpartitioning")[1].split("]")[0].split(",")[0]
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_hot_tickers_give_the_same_sums(spark, monkeypatch):
    t = V._marked(V.trades(spark, SF))
    plain = sorted(map(tuple, V._daily_sums(t, 4).collect()))
    monkeypatch.setattr(V, "HOT_TRADES", 10)
    hot = V._daily_sums(t, 4)
    assert "hashpartitioning(ticker" in hot._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hot.collect())) == plain and len(plain) > 1000


def test_buckets_follow_the_size_of_the_trades(spark, monkeypatch, tmp_path):
    os.symlink(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    monkeypatch.setattr(V, "BUCKET_BYTES", 1 << 13)
    days = V.daily(spark, str(tmp_path))
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    assert days.select("ticker").inputFiles() and spark.sql(f"DESCRIBE EXTENDED {V._DAILY[next(k for k in V._DAILY if str(tmp_path) in k[1])]}").where("col_name = 'Num Buckets'").first()["data_type"] == str(size >> 13)
    assert V.BUCKET_BYTES < 1 << 14 and days.count() > 0


def test_footnotes_join_the_trades_once(spark):
    """The shares of the buyers are stored before histories and segments read them."""
    from factorlake.catalog import footnotes as FN

    plan = FN.landed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "daily_" in plan and "o_custkey" not in plan and "l_suppkey" not in plan


def test_holdings_join_the_trades_once(spark):
    """The quarters are stored, so what reads the holdings several times scans neither trades nor orders."""
    plan = V.holdings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan
