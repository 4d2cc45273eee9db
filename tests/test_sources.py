"""Readers, sinks, statement assembly."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factorlake.operators import statements as ST
from factorlake.sources import readers as RD, sinks as SK


def write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(p)


def test_quotes(spark, tmp_path):
    p = write(tmp_path, "q.json", [{"ticker": "A", "quoteType": "etf", "marketCap": 5.0, "dividendYield": 5.4, "trailingPE": "NaN", "shortName": "", "longName": "Long"},
                                   {"ticker": "B", "quoteType": "EQUITY", "trailingPE": "Infinity", "returnOnEquity": "0.5"}])
    a, b = RD.read_quotes(spark, p).orderBy("ticker").collect()
    assert (a["asset_type"], a["dividendYield"], a["trailingPE"], a["name"]) == ("ETF", pytest.approx(0.054), None, "Long")
    assert (b["asset_type"], b["trailingPE"], b["returnOnEquity"], b["marketCap"]) == ("STOCK", None, 0.5, None)


def test_quote_modules(spark):
    m = {"summaryDetail": {"trailingPE": 12.5, "currency": "USD", "marketCap": "oops"}, "quoteType": {"quoteType": "etf", "shortName": "Fund"},
         "fundProfile": {"feesExpensesInvestment": {"annualReportExpenseRatio": 0.0003}}, "financialData": "missing"}
    d = spark.createDataFrame([("A", json.dumps(m)), ("B", "{}")], "ticker string, modules string")
    a, b = RD.flatten_quote_modules(d).orderBy("ticker").collect()
    assert (a["trailing_pe"], a["market_cap"], a["quote_type"], a["annual_expense_ratio"], a["current_price"]) == (12.5, None, "ETF", pytest.approx(0.03), None)
    assert b["trailing_pe"] is None and b["quote_type"] is None


def test_prices_adjustment_and_points(spark, tmp_path):
    raw = spark.createDataFrame([("A", "2024-01-02", "10", "12", "8", "10", "5", "100"), ("A", "2024-01-03", "10", "12", "8", "0", None, None), ("A", "bad", "1", "1", "1", "1", "1", "1"), ("A", "2024-01-04", None, "1", "1", "1", "1", "1")],
                                "ticker string, date string, open string, high string, low string, close string, adj_close string, volume string")
    r = RD.adjust_ohlc(raw).orderBy("session").collect()
    assert [(x["open"], x["close"], x["volume"]) for x in r] == [(5.0, 5.0, 100), (10.0, 0.0, 0)]
    p = write(tmp_path, "p.json", [{"ticker": "A", "data": [[1704153600000, 1.5], [1704240000000, 2.5]]}])
    assert [(str(x["session"]), x["close"]) for x in RD.read_price_points(spark, p).orderBy("session").collect()] == [("2024-01-02", 1.5), ("2024-01-03", 2.5)]
    csv = write(tmp_path, "b.csv", ["ticker,session,open,high,low,close,adjclose,volume", "A,2024-01-02,1,1,1,10,9,5", "A,2024-01-03,1,1,1,11,,5", "A,2024-01-04,1,1,1,,,5"])
    assert [x["close"] for x in RD.read_prices(spark, csv, "csv").orderBy("session").collect()] == [9.0, 11.0]


def test_vendor_bars_parse_each_text_once(spark):
    """Seven texts, seven conversions in the whole plan: none is repeated per factor or in the filter of malformed rows."""
    names = ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")
    raw = spark.range(3).select(*[F.concat(F.lit("1"), F.col("id").cast("string")).alias(c) for c in names])
    plan = RD.adjust_ohlc(raw)._jdf.queryExecution().optimizedPlan().toString()
    casts = sum(plan.count(f" as {kind})") for kind in ("double", "date", "bigint"))
    assert casts == 7, plan


def test_vendor_bars_that_are_no_numbers_drop_out(spark):
    rows = [("A", "2024-01-02", "NaN", "1", "1", "2", "1", "1"), ("A", "2024-01-03", "1", "1", "1", "2", "NaN", "1"), ("A", "2024-01-04", "1", "1", "1", None, "3", "x"),
            ("A", "2024-01-05", "1", "1", "1", None, "0", "1"), (None, "2024-01-06", "1", "1", "1", "2", "0", "1")]
    raw = spark.createDataFrame(rows, "ticker string, date string, open string, high string, low string, close string, adj_close string, volume string")
    got = [(x["ticker"], str(x["session"]), x["open"], x["close"], x["volume"]) for x in RD.adjust_ohlc(raw).orderBy("session").collect()]
    assert got == [("A", "2024-01-04", 1.0, 3.0, 0), (None, "2024-01-06", 1.0, 2.0, 1)]


def test_pit_statements_skip_bad_dates(spark, tmp_path):
    base = {"ticker": "A", "statement": "income", "fiscalYear": "2023", "fiscalPeriod": "FY", "facts": {"netIncome": 1.5}}
    p = write(tmp_path, "s.json", [{**base, "period": "2023-09-30T00:00:00", "dateFiled": "2023-11-03T10:00:00Z"}, {**base, "period": "2023-09-30"}, {**base, "period": "x", "dateFiled": "2023-11-03"}])
    rows = RD.read_pit_statements(spark, p).collect()
    assert [(r["period_end"], r["date_filed"], r["fiscal_year"], r["facts"]) for r in rows] == [(dt.date(2023, 9, 30), dt.date(2023, 11, 3), 2023, {"netIncome": 1.5})]


def facts_frame(spark, concepts):
    payload = {"us-gaap": {c: {"units": {"USD": rows}} for c, rows in concepts.items()}, "dei": {"X": {"units": {"u": [{"end": "2024-01-01", "filed": "2024-01-02", "val": 1, "form": "10-K", "fp": "FY"}]}}}}
    return spark.createDataFrame([(1, json.dumps(payload))], "cik long, j string").select("cik", F.from_json("j", RD.COMPANYFACTS).alias("facts"))


def fact(end, filed, val, form="10-K", fp="FY"):
    return {"end": end, "filed": filed, "val": val, "form": form, "fp": fp}


def test_companyfacts_to_periods(spark):
    d = facts_frame(spark, {
        "NetIncomeLoss": [fact("2022-12-31", "2023-02-01", 10.0), fact("2022-12-31", "2024-02-01", 11.0), fact("2023-12-31", "2024-02-01", 20.0), fact("2023-09-30", "2024-02-01", 5.0), fact("2023-06-30", "2023-08-01", 1.0, "10-Q", "Q2")],
        "SalesRevenueNet": [fact("2023-12-31", "2024-02-01", 90.0)], "Revenues": [fact("2023-12-31", "2024-02-01", 100.0), fact("2023-12-31", "2024-02-01", 101.0)],
        "CostOfRevenue": [fact("2023-12-31", "2024-02-01", 60.0)], "LongTermDebtNoncurrent": [fact("2023-12-31", "2024-02-01", 7.0)], "LongTermDebtCurrent": [fact("2023-12-31", "2024-02-01", 3.0)],
        "CommercialPaper": [fact("2023-12-31", "2024-02-01", 2.0)], "NetCashProvidedByUsedInOperatingActivities": [fact("2023-12-31", "2024-02-01", 30.0)],
        "Assets": [fact("2021-12-31", "2022-02-01", 1.0)]})
    rows = {str(r["end"]): r for r in ST.filed_periods(RD.flatten_companyfacts(d)).collect()}
    assert set(rows) == {"2023-12-31", "2022-12-31"}  # the quarter-length one is thinned out, assets alone are no fiscal year
    new, old = rows["2023-12-31"], rows["2022-12-31"]
    assert (old["netIncome"], str(old["filed"])) == (10.0, "2023-02-01")  # first filing, not the later comparative
    assert (new["revenue"], new["grossProfit"], new["totalDebt"], new["freeCashFlow"]) == (101.0, 41.0, 12.0, None)


def test_ttm_block_shapes(spark):
    d = spark.createDataFrame([("A", "cik", '{"data":[{"facts":{"eps":9}}]}'), ("A", "symbol", '{"data":[{"facts":{"eps":1.5,"x":"n/a"}},{"facts":{"eps":3}}]}'),
                               ("B", "cik", '[{"facts":{"eps":2}}]'), ("C", "symbol", '{"facts":{"eps":4}}'), ("D", "symbol", '{"data":[]}'), ("E", "symbol", "broken")],
                              "ticker string, selector string, payload string")
    got = {r["ticker"]: r["facts"] for r in RD.ttm_block(d).collect()}
    assert got == {"A": {"eps": 1.5, "x": None}, "B": {"eps": 2.0}, "C": {"eps": 4.0}}


def test_holdings_page(spark):
    row = lambda s, p: f'<tr class="x"><td class="hist"></td>\n<td class="stock"><a href="/m/stock.php?sym={s}">{s}<span> - Name</span></a></td>\n<td class="sold">{p}</td></tr>'
    html = "<p>Period: <b>Q3  2026</b></p><table>" + row("BRK.B", "12.34") + row("AAPL", "1,005.5") + row("AAPL", "2.0") + "<tr><td>none</td></tr></table>"
    d = spark.createDataFrame([("m1", html)], "manager string, html string")
    assert {(r["symbol"], r["pct"]) for r in RD.extract_holdings(d).collect()} == {("BRK.B", 12.34), ("AAPL", 1005.5)}
    assert d.select(RD.report_period("html").alias("p")).first()["p"] == "Q3 2026"
    m = spark.createDataFrame([('<a href="/m/holdings.php?m=BRK">Warren B </a><a href="/x">no</a>',)], "html string")
    assert [tuple(r) for r in RD.extract_managers(m).collect()] == [("BRK", "Warren B")]


def test_small_text_sources(spark, tmp_path):
    t = write(tmp_path, "t.txt", ["# my list", "AAPL, MSFT\tSAP.DE  # held", "", "  NVDA"])
    assert [r["ticker"] for r in RD.read_ticker_list(spark, t).collect()] == ["AAPL", "MSFT", "SAP.DE", "NVDA"]
    c = write(tmp_path, "c.csv", ["Date,1 Mo,2 Yr,10 Yr", "01/02/2024,5.5,4.3,3.9", "01/03/2024,5.5,N/A,3.9", "bad,1,1,1"])
    assert [(str(r["session"]), r["y10"], r["y2"]) for r in RD.read_treasury_curve(spark, c).collect()] == [("2024-01-02", 3.9, 4.3)]
    s = write(tmp_path, "s.json", [{"fear_and_greed": {"score": 61.5, "rating": " Greed ", "timestamp": "2026-06-05T19:59:59Z"}, "put_call_options": {"score": 10, "rating": "fear"}, "unknown": {"score": 1}}])
    r = RD.read_sentiment(spark, s).collect()
    assert [(x["score"], x["rating"], str(x["at"]), x["indicator"], x["sub_score"]) for x in r] == [(61.5, "greed", "2026-06-05 19:59:59", "put_call_options", 10.0)]
    panel = write(tmp_path, "w.csv", ["Date,A,B"] + [f"2024-01-{i:02d},{i},{i if i < 3 else ''}" for i in range(1, 7)])
    assert {(r["instrument"]) for r in RD.read_price_panel(spark, panel, 4).collect()} == {"A"}
    wide = spark.createDataFrame([("A", "income", "Net Income", 80.0, 70.0), ("A", "income", "Other", 1.0, 1.0)], "ticker string, statement string, label string, `2023-12-31` double, `2022-12-31` double")
    assert {(r["fact"], str(r["period_end"]), r["value"]) for r in RD.statement_rows(wide).collect()} == {("net_income", "2023-12-31", 80.0), ("net_income", "2022-12-31", 70.0)}


def test_insight_charts(spark):
    a = {"periods": ["2022-12-31", "2023-12-31"], "series": [{"name": "Revenue", "data": [1.0, 2.0]}], "rates": [{"name": "Net Margin", "data": [0.1]}]}
    b = {"periods": ["2023-12-31", "2024-12-31"], "rates": [{"name": "Current Ratio", "data": [1.5, 1.6]}]}
    d = spark.createDataFrame([("A", json.dumps(a)), ("A", json.dumps(b))], "ticker string, chart string")
    got = {r["period_end"]: (r["revenue"], r["net_margin"], r["current_ratio"]) for r in RD.insight_periods(d).collect()}
    assert got == {"2022-12-31": (1.0, 0.1, None), "2023-12-31": (2.0, None, 1.5), "2024-12-31": (None, None, 1.6)}


def test_combine_takes_the_first_statement_even_when_null(spark):
    d = spark.createDataFrame([("A", dt.date(2023, 12, 31), "balance", "equity", 5.0), ("A", dt.date(2023, 12, 31), "income", "equity", None), ("A", dt.date(2023, 12, 31), "cash", "fcf", 3.0)],
                              "ticker string, period_end date, statement string, fact string, value double")
    r = ST.combine_statements(d, ["income", "balance", "cash"], ["equity", "fcf"]).first()
    assert (r["equity"], r["fcf"]) == (None, 3.0)


def test_saved_periods_survive_an_empty_series(spark, tmp_path):
    path = str(tmp_path / "pit")
    schema = "ticker string, period_end date, date_filed date, stitched boolean"
    y = lambda n: dt.date(n, 12, 31)
    SK.save_periods(spark.createDataFrame([(t, y(2022), y(2023), False) for t in ("A", "B", "C")], schema), path, buckets=2)
    SK.save_periods(spark.createDataFrame([("A", y(2023), y(2024), True), ("A", y(2022), y(2023), True)], schema), path, buckets=2)
    got = {r["ticker"]: (r["periods"], r["stitched"]) for r in SK.inventory(spark.read.parquet(path)).collect()}
    assert got == {"A": (2, True), "B": (1, False), "C": (1, False)}


def test_metric_sink_keeps_other_tags(spark, tmp_path):
    path = str(tmp_path / "m")
    for tag in ("one", "two", "one"):
        SK.write_metrics(spark.createDataFrame([(0.5,)], "alpha double"), path, tag, {"n": "10"})
    assert sorted(r["tag"] for r in spark.read.json(path).collect()) == ["one", "two"]


def test_dedupe_and_surprise(spark):
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("A", t, 1.0, 1), ("A", t, 2.0, 2)], "ticker string, reported_at timestamp, surprise_pct double, landed long")
    assert [r["surprise_pct"] for r in RD.last_per_stamp(d, "landed").collect()] == [2.0]
    e = spark.createDataFrame([("A", i, a, s) for i, (a, s) in enumerate([(9.0, 1.0), (1.1, 1.0), (None, 1.0), (2.0, 0.0), (-0.5, -1.0)])], "ticker string, date int, actual double, estimate double")
    assert RD.surprise_from_actuals(e).first()["eps_surprise"] == pytest.approx((10.0 + 50.0) / 2)


def test_stitching_guards(spark):
    today = F.lit(dt.date(2024, 6, 30))
    per = [(1, dt.date(2023, 12, 31))] + [(2, dt.date(y, 12, 31)) for y in range(2016, 2024)] + [(3, dt.date(y, 12, 31)) for y in range(2000, 2016)] + [(4, dt.date(y, 12, 31)) for y in range(2010, 2024)]
    periods = spark.createDataFrame(per, "cik long, period_end date")
    ents = spark.createDataFrame([(1, "XOM", "ExxonMobil Holdings Corp", "stock"), (2, None, "EXXON MOBIL CORP", "stock"), (3, None, "Exxon Old Corp", "stock"), (4, None, "Exxon Fund", "fund")], "cik long, ticker string, name string, kind string")
    r = ST.stitch_entities(periods, ents, today).collect()
    assert [(x["ticker"], x["cik"], x["periods"]) for x in r] == [("XOM", 2, 8)]  # 3 stopped filing, 4 is a fund


def test_bucketed_prices_need_no_shuffle(spark, tmp_path):
    from factorlake.operators import technicals as T
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i + k) for k in range(8) for i in range(30)]
    SK.save_by_ticker(spark.createDataFrame(rows, "ticker bigint, session date, close double"), "factorlake_prices_t", str(tmp_path / "b"), 4, ["session"])
    try:
        plan = T.bar_features(spark.table("factorlake_prices_t"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan
    finally:
        spark.sql("DROP TABLE factorlake_prices_t")
