"""Filters, holdings, portfolio rules, risk signals, macro, streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factorlake.operators import filters as L, holdings as H, macro as MC, risk as K, sessions as SS
from factorlake.plans import advisor as AD, research as Q
from factorlake.streaming import market_streams as MS


def test_filters_three_valued(spark):
    d = spark.createDataFrame([("A", "USD", 5.0, "Technology"), ("B", None, None, None), ("C", "EUR", 1.0, "tech hardware")], "ticker string, currency string, market_cap double, sector string")
    names = lambda x: sorted(r["ticker"] for r in x.collect())
    assert names(L.currency(d, ["USD"])) == ["A", "B"] and names(L.currency(d, ["all"])) == ["A", "B", "C"]
    assert names(L.min_cap(d, 2.0)) == ["A"] and names(L.min_cap(d, 0.0)) == ["A", "B", "C"]
    assert names(L.sector_prefix(d, "TECH")) == ["A", "C"]
    assert L.default_min_cap(None, True) == 0.0 and L.default_min_cap(None, False) == 2e9
    prices = spark.createDataFrame([(t, 1) for t in "ABC"], "ticker string, x int")
    assert names(L.early_cap_gate(prices, d, 2.0)) == ["A", "B"]
    e = d.withColumn("errors", F.when(F.col("ticker") == "A", F.array(F.lit("x"))))
    assert names(L.without_errors(e)) == ["B", "C"]


def test_universe(spark):
    u = spark.createDataFrame([(1, "stocks", "us", 1, "TSM"), (3, "stocks", "asia", 1, "2330.TW"), (4, "stocks", "consensus", 1, "tsm"), (5, "etfs", "us", 1, "VXUS")], "pool int, asset_class string, region string, ord int, ticker string")
    al = spark.createDataFrame([("2330.TW", "TSM")], "alias string, canonical string")
    assert [r["ticker"] for r in L.distinct_pools(L.canonical_ticker(L.select_pools(u, "stocks"), al)).collect()] == ["TSM"]
    only_asia = L.select_pools(u, "stocks", ["asia"])
    assert [r["ticker"] for r in L.canonical_ticker(only_asia, al).collect()] == ["2330.TW"]
    assert sorted(r["pool"] for r in L.select_pools(u, "stocks", ["us"]).collect()) == [1, 4]
    assert L.region_codes(["USD"]) == ["consensus", "us"] and L.region_codes(["USD", "BRL"]) == ["all"] and L.region_codes(["JPY"]) == ["asia"]


def test_enrich_and_fallback(spark):
    s = "ticker string, market_cap double, trailing_pe double, price_to_book double, eps_surprise double"
    a = spark.createDataFrame([("A", None, 10.0, 1.0, None), ("B", 500.0, 225.0, 1.0, None), ("C", 110.0, 225.0, 1.0, 3.0), ("D", 1.0, 1.0, 1.0, 1.0)], s)
    b = spark.createDataFrame([("A", 7.0, 99.0, 9.0, 4.0), ("B", 100.0, 20.0, 2.0, 5.0), ("C", 100.0, 20.0, 2.0, 5.0)], s)
    got = {r["ticker"]: tuple(r)[1:] for r in L.enrich(a, b).collect()}
    assert got["A"] == (7.0, 10.0, 1.0, 4.0, False) and got["B"] == (100.0, 20.0, 2.0, 5.0, True)
    assert got["C"] == (110.0, 225.0, 1.0, 3.0, False) and got["D"][-1] is False


def test_consensus_and_audit(spark):
    h = spark.createDataFrame([("m1", "BRK.B", 5.0), ("m2", "brk.b", 2.0), ("m1", "GOOG", 1.0), ("m1", "GOOGL", 1.0), ("m2", "X", 9.0), ("m1", "bad$", 1.0), ("m2", "bad$", 1.0)], "manager string, symbol string, pct double")
    got = {r["symbol"]: (r["manager_count"], r["total_weight"]) for r in H.consensus(h, 2).collect()}
    assert got == {"BRK-B": (2, 7.0), "GOOGL": (2, 2.0)}
    p = spark.createDataFrame([("Q3 2026",)] * 3 + [("Q2 2026",)], "period string")
    assert [(r["period"], r["managers"], r["rank"]) for r in H.report_quarter(p).orderBy("rank").collect()] == [("Q3 2026", 3, 1), ("Q2 2026", 1, 2)]


def test_portfolio_review(spark):
    d = spark.createDataFrame([("p", 30.0, "Tech"), ("p", 55.0, "Tech"), ("p", 80.0, None), ("q", 60.0, "Energy")], "portfolio string, total double, sector string")
    r = {x["portfolio"]: x for x in AD.portfolio_review(d, ["portfolio"]).collect()}
    assert (r["p"]["weak"], r["p"]["moderate"], r["p"]["strong"], r["p"]["avg_score"], r["p"]["crowded_sectors"], r["p"]["few_holdings"]) == (1, 1, 1, 55.0, "Tech", True)
    assert r["q"]["crowded_sectors"] == ""  # fewer than three holdings


def test_report_order_nulls(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "symbol string, v double")
    assert [r["symbol"] for r in d.orderBy(*L.report_order("v", False)).collect()] == ["a", "c", "b"]
    assert [r["symbol"] for r in d.orderBy(*L.report_order("v", True)).collect()] == ["b", "c", "a"]


def test_macro_score(spark):
    def score(*v):
        return spark.range(1).select(MC.macro_score(*[F.lit(x).cast("double") for x in v]).alias("s")).first()["s"]
    assert score(*[None] * 8) == 50
    assert score(10, 1.5, 50, 90, 20, -1, -1, -1) == 100 and score(40, -1, 130, 110, 80, 1, 1, 1) == 0
    assert score(30, 0.2, 110, 102, 60, 0, None, 1) == 24
    assert spark.range(1).select(MC.volatility_regime(F.lit(35.0))).first()[0] == "bearish"
    for s, want in ((70, "healthy"), (45, "neutral"), (25, "warning"), (24, "danger")):
        assert spark.range(1).select(MC.macro_regime(F.lit(s))).first()[0] == want


def test_sessions(spark):
    p = spark.createDataFrame([("A", dt.date(2024, 7, 1), 10.0), ("A", dt.date(2024, 7, 2), 11.0)], "ticker string, session date, close double")
    now = lambda s: F.lit(s).cast("timestamp")
    assert SS.drop_partial_session(p, now("2024-07-02 19:59:00")).count() == 1 and SS.drop_partial_session(p, now("2024-07-02 20:00:00")).count() == 2
    q = spark.createDataFrame([("A", "2024-07-03T20:00:00Z", 12.0, 99.0)], "ticker string, quoted_at string, regular_price double, current_price double")
    assert SS.reconcile_quote_session(p, q, now("2024-07-03 19:00:00")).count() == 2  # still open
    last = SS.reconcile_quote_session(p, q, now("2024-07-03 21:00:00")).orderBy(F.col("session").desc()).first()
    assert (last["session"], last["close"]) == (dt.date(2024, 7, 3), 12.0)


def foot(spark, kind, payload):
    return spark.createDataFrame([("A", kind, json.dumps(payload))], "ticker string, kind string, payload string").withColumn("payload", F.try_parse_json("payload"))


def signals(spark, kind, payload, cap=None, revenue=None):
    caps = spark.createDataFrame([("A", cap)], "ticker string, market_cap double")
    rev = spark.createDataFrame([("A", revenue)], "ticker string, revenue double")
    return [(r["severity"], r["label"], r["detail"]) for r in K.footnote_signals(foot(spark, kind, payload), caps, rev, F.lit(2026)).collect()]


def test_concentration_payload(spark):
    p = {"series": [{"riskType": "Customer", "counterparties": [{"name": "Big", "history": [{"period": "2023", "share": 0.2}, {"period": "2024", "share": 35}]}, {"name": "Small", "history": [{"period": "2024", "share": 0.1}]}]},
                    {"riskType": "supplier", "counterparties": [{"name": "Sup", "share": 0.31}]}]}
    got = signals(spark, "concentration", p)
    assert ("medium", "Key-customer concentration", "Big at 35% of revenue (20% → 35% over the disclosed history)") in got
    assert ("info", "Supplier concentration", "Sup at 31% of purchases") in got and len(got) == 2


@pytest.mark.parametrize("kind,payload,cap,want", [
    ("debt-structure", [{"fiscalYear": 2025, "instruments": [{"dueYear": 2027, "faceAmount": 30.0}, {"dueYear": 2035, "faceAmount": 70.0}]}], None, [("medium", "Debt maturity wall")]),
    ("debt-structure", [{"fiscalYear": 2025, "instruments": [{"dueYear": 2027, "faceAmount": 20.0}, {"dueYear": 2035, "faceAmount": 80.0}]}], None, []),
    ("credit-facilities", {"facilities": [{"utilization": 80}, {"utilization": 0.2}]}, None, [("medium", "Credit facilities heavily drawn")]),
    ("credit-facilities", {"facilities": [{"utilization": 0.5}]}, None, [("info", "High credit-line utilization")]),
    ("stock-compensation", [{"fiscalYear": 2025, "planTotals": [{"unrecognizedCost": 20.0}]}], 100.0, [("medium", "Unvested equity compensation")]),
    ("stock-compensation", [{"fiscalYear": 2025, "unrecognizedCost": 4.0}], 100.0, []),
    ("stock-compensation", [{"fiscalYear": 2025, "unrecognizedCost": 4.0}], None, [("info", "Unvested equity compensation")]),
    ("retirement-plans", [{"fiscalYear": 2025, "plans": [{"fundedStatus": -8.0}, {"fundedStatus": 3.0}]}], 100.0, [("medium", "Underfunded pension plans")]),
    ("supplier-finance", [{"fiscalYear": 2025, "totals": {"outstandingBalance": 3.0, "settledObligations": 900.0}}], 100.0, [("info", "Supplier-finance obligations")]),
    ("fair-value-hierarchy", [{"fiscalYear": 2025, "measures": [{"level3Share": 0.3}]}], None, [("info", "Opaque Level 3 valuations")]),
    ("fair-value-hierarchy", "text", None, []), ("debt-structure", [1, 2], None, []), ("concentration", {"x": 1}, None, [])])
def test_payload_rules(spark, kind, payload, cap, want):
    assert [(s, l) for s, l, _ in signals(spark, kind, payload, cap)] == want


def test_segmentation_payloads(spark):
    geo = {"countries": [{"name": "United States", "continent": "NA", "value": 144.5}], "regions": [{"name": "Non-US", "value": 137.2}, {"name": "Americas", "continent": "NA", "value": 144.5}], "usStates": [{"name": "CA", "value": 50}]}
    block = [{"fiscalYear": 2025, "geography": geo, "product": [{"name": "Gross", "value": 500}, {"name": "Cloud", "value": 140}]}]
    assert [x[1] for x in signals(spark, "revenue-segmentation", block, None, 281.7)] == ["Product revenue concentration"]  # 51 % US is below the watch level
    mostly = [{"fiscalYear": 2025, "geography": {"countries": [{"name": "US", "continent": "NA", "value": 90.0}, {"name": "DE", "continent": "EU", "value": 10.0}]}}]
    assert signals(spark, "revenue-segmentation", mostly, None, 100.0) == [("info", "Geographic revenue concentration", "90% of revenue from US")]
    assert signals(spark, "revenue-segmentation", mostly, None, 250.0) == []  # does not reconcile
    seg = [{"fiscalYear": 2025, "segments": [{"name": "Main", "metrics": {"revenue": 70}}, {"name": "Other", "metrics": {"revenue": 30}}, {"name": "Elim", "role": "elimination", "metrics": {"revenue": 900}}]}]
    assert signals(spark, "business-segmentation", seg) == [("info", "Segment revenue concentration", "70% of revenue from the Main segment")]


def test_field_comparison(spark):
    a = spark.createDataFrame([("A", 2.0, None), ("B", 0.005, 1.0)], "ticker string, x double, y double")
    b = spark.createDataFrame([("A", 1.0, 3.0), ("B", 0.006, 1.0)], "ticker string, x double, y double")
    got = {r["field"]: (round(r["avg_rel_diff"], 6), r["max_rel_diff"], r["missing_count"]) for r in Q.field_accuracy(a, b, ["x", "y"]).collect()}
    assert got["x"] == (25.05, 50.0, 0) and got["y"] == (50.0, 100.0, 1)
    cov = {r["field"]: r["coverage"] for r in Q.field_coverage(a, ["x", "y"], []).collect()}
    assert cov == {"x": 100.0, "y": 50.0}


def test_stream_bars_equal_batch_for_closed_days(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows = [("k", dt.datetime(2024, 1, day, h), float(day * 10 + h)) for day in (1, 2, 3) for h in (1, 5, 23)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").write.parquet(src)
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(src)
    MS.run_available(MS.daily_bars(stream), out, state)
    got = {str(r["session"]): (r["close"], r["ticks"]) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": (pytest.approx(59 / 3), 3), "2024-01-02": (pytest.approx(89 / 3), 3)}  # the open third day is held back
