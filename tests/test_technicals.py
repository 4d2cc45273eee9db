"""Price features against pandas, as-of joins, no look-ahead."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.operators import asof as A, fundamentals as U, technicals as T


def series(n, seed=42, start=dt.date(2020, 1, 1)):
    rng = np.random.default_rng(seed)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return [start + dt.timedelta(days=i) for i in range(n)], closes


def frame(spark, data):
    rows = [(t, d, float(c)) for t, (ds, cs) in data.items() for d, c in zip(ds, cs)]
    return spark.createDataFrame(rows, "ticker string, session date, close double")


def expected(c):
    c = pd.Series(c)
    ret = c.pct_change()
    sma = c.rolling(200).mean()
    delta = c.diff()
    g, l = delta.clip(lower=0).rolling(14).mean(), (-delta).clip(lower=0).rolling(14).mean()
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    hist = line - line.ewm(span=9, adjust=False).mean()
    return {"daily_change": ret, "return_1m": c / c.shift(21) - 1, "return_12m": c / c.shift(251) - 1, "price_vs_sma200": c / sma - 1,
            "sma200_slope": sma / sma.shift(125) - 1, "volatility_1y": ret.rolling(251).std() * np.sqrt(252), "rsi_14": 100 - 100 / (1 + g / l),
            "pct_off_high": c / c.rolling(252, min_periods=1).max() - 1, "macd_line": line / c, "macd_histogram": hist / c}


def test_bars_match_pandas(spark):
    ds, cs = series(547)
    p = frame(spark, {"A": (ds, cs)})
    got = T.bar_features(p).join(T.macd_bars(p).drop("close"), ["ticker", "session"]).toPandas().sort_values("session").reset_index(drop=True)
    want = expected(cs)
    for name, w in want.items():
        first = {"rsi_14": 34, "macd_line": 34, "macd_histogram": 34, "volatility_1y": 251, "pct_off_high": 1}.get(name, 0)
        for i in range(len(cs)):
            g = got[name][i]
            if i < first or pd.isna(w[i]):
                assert pd.isna(g), (name, i, g)
            else:
                assert g == pytest.approx(w[i], abs=1e-11), (name, i)


def test_macd_over_many_blocks(spark):
    ds, cs = series(3 * T.EMA_BLOCK + 17, 7, dt.date(1990, 1, 1))
    got = T.macd_bars(frame(spark, {"A": (ds, cs)})).toPandas().sort_values("session").reset_index(drop=True)
    want = expected(cs)
    np.testing.assert_allclose(got["macd_histogram"][40:], want["macd_histogram"][40:], atol=1e-13)


def test_flat_series_has_rsi_100_and_nan_is_dropped(spark):
    ds, _ = series(40)
    rows = [("A", d, 10.0) for d in ds] + [("A", ds[-1] + dt.timedelta(days=1), float("nan"))]
    p = spark.createDataFrame(rows, "ticker string, session date, close double")
    last = T.bar_features(p).orderBy(F.col("session").desc()).first()
    assert last["rsi_14"] == 100.0 and last["n"] == 40


def dates_frame(spark, *days):
    return spark.createDataFrame([(list(days),)], "dates array<date>")


def test_snapshot_features_do_not_look_ahead(spark):
    ds, cs = series(400)
    cut = ds[330]
    days = dates_frame(spark, ds[300], cut)
    full = T.features_at(frame(spark, {"A": (ds, cs)}), days).orderBy("snapshot").collect()
    short = T.features_at(frame(spark, {"A": (ds[:331], cs[:331])}), days).orderBy("snapshot").collect()
    assert full == short and [r["session"] for r in full] == [ds[300], cut]
    assert full[0]["price"] == pytest.approx(cs[300])


def test_asof_between_before_and_after(spark):
    p = spark.createDataFrame([("A", dt.date(2024, 1, 2), 10.0), ("A", dt.date(2024, 1, 5), None), ("A", dt.date(2024, 1, 9), 12.0)], "ticker string, session date, close double")
    q = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 2, 7, 9, 30)], "ticker string, snapshot date")
    got = [r["close"] for r in A.asof_close(q, p).orderBy("snapshot").collect()]
    assert got == [None, 10.0, 10.0, 12.0, 12.0]
    at = T.features_at(p, dates_frame(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 7)), (183,)).collect()
    assert len(at) == 1 and at[0]["price"] == 10.0 and at[0]["close_183"] == 12.0


FACTS = ("net_income", "revenue", "eps", "gross_profit", "total_assets", "equity", "total_debt", "current_assets", "current_liabilities", "shares", "fcf")


def annual(spark, rows):
    """rows: (period_end, date_filed, {fact: value})."""
    schema = "ticker string, period_end date, date_filed date, " + ", ".join(f"{f} double" for f in FACTS)
    return spark.createDataFrame([("A", e, f, *[v.get(x) for x in FACTS]) for e, f, v in rows], schema)


def features(spark, rows, snapshot, clock, divs=(), earn=()):
    at = spark.createDataFrame([("A", snapshot, 50.0)], "ticker string, snapshot date, price double")
    d = spark.createDataFrame(list(divs), "ticker string, ex_date date, amount double")
    e = spark.createDataFrame(list(earn), "ticker string, reported_at date, eps_reported double, surprise_pct double")
    return U.historical_features(at, annual(spark, rows), d, e, 60, clock=clock).collect()


BASE = dict(net_income=100.0, revenue=1000.0, eps=5.0, gross_profit=400.0, total_assets=2000.0, equity=500.0, total_debt=250.0,
            current_assets=300.0, current_liabilities=150.0, shares=20.0, fcf=80.0)


def test_filing_day_gates_visibility(spark):
    old = {**BASE, "net_income": 80.0, "revenue": 900.0}
    rows = [(dt.date(2022, 12, 31), dt.date(2023, 3, 1), old), (dt.date(2023, 12, 31), dt.date(2024, 3, 1), BASE)]
    before = features(spark, rows, dt.date(2024, 2, 29), "filed")[0]
    after = features(spark, rows, dt.date(2024, 3, 1), "filed")[0]
    assert before["ni"] == 80.0 and before["earnings_growth"] is None
    assert after["ni"] == 100.0 and after["earnings_growth"] == pytest.approx(0.25)
    assert after["trailing_pe"] == 10.0 and after["market_cap"] == 1000.0 and after["price_to_book"] == 2.0 and after["debt_to_equity"] == 50.0
    # the fixed lag shows FY2023 from 60 days after the quarter
    assert features(spark, rows, dt.date(2024, 2, 28), "period")[0]["ni"] == 80.0
    assert features(spark, rows, dt.date(2024, 2, 29), "period")[0]["ni"] == 100.0


def test_null_fact_of_the_newest_period_stays_null(spark):
    rows = [(dt.date(2022, 12, 31), dt.date(2023, 3, 1), BASE), (dt.date(2023, 12, 31), dt.date(2024, 3, 1), {**BASE, "fcf": None})]
    assert features(spark, rows, dt.date(2024, 6, 1), "filed")[0]["free_cashflow"] is None


def test_sign_guards(spark):
    bad = {**BASE, "eps": -2.0, "equity": -10.0, "total_debt": 0.0}
    r = features(spark, [(dt.date(2023, 12, 31), dt.date(2024, 3, 1), bad)], dt.date(2024, 6, 1), "filed")[0]
    assert r["trailing_pe"] is None and r["price_to_book"] is None and r["return_on_equity"] is None and r["debt_to_equity"] is None and r["peg_ratio"] is None
    ok = features(spark, [(dt.date(2023, 12, 31), dt.date(2024, 3, 1), {**BASE, "total_debt": 0.0, "shares": None})], dt.date(2024, 6, 1), "filed")[0]
    assert ok["debt_to_equity"] == 0.0 and ok["shares"] == 20.0  # NI / EPS


def test_dividend_window_is_half_open_and_surprise_uses_newest_four(spark):
    rows = [(dt.date(2023, 12, 31), dt.date(2024, 3, 1), BASE)]
    snap = dt.date(2024, 6, 30)
    divs = [("A", snap - dt.timedelta(days=365), 0.24), ("A", snap - dt.timedelta(days=366), 10.0), ("A", snap, 50.0), ("A", snap - dt.timedelta(days=1), 0.25)]
    day0 = snap - dt.timedelta(days=60)
    earn = [("A", day0 - dt.timedelta(days=91 * i), 1.0, s) for i, s in enumerate([10.0, 8.0, 6.0, 4.0, 2.0])] + [("A", day0 + dt.timedelta(days=1), 1.0, 99.0)]
    r = features(spark, rows, snap, "filed", divs, earn)[0]
    assert r["ttm_div"] == pytest.approx(0.49) and r["eps_surprise"] == pytest.approx(7.0)


def test_ttm_needs_four_quarters(spark):
    q = [("A", dt.date(2024, 3 * i, 28), 10.0, 5.0 if i > 1 else None, 100.0 * i) for i in range(1, 5)] + [("B", dt.date(2024, 3, 28), 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(q, "ticker string, period_end date, net_income double, fcf double, equity double")
    rows = U.ttm_facts(d, ["net_income", "fcf"], ["equity"]).collect()
    assert [(r["ticker"], r["net_income"], r["fcf"], r["equity"]) for r in rows] == [("A", 40.0, None, 400.0)]


def health(spark, cur, prev):
    names = ["net_income", "total_assets", "ocf", "total_debt", "current_assets", "current_liabilities", "shares", "gross_profit", "revenue",
             "retained_earnings", "ebit", "total_liabilities", "equity"]
    st = lambda d: F.struct(*[F.lit(d.get(n)).cast("double").alias(n) for n in names])
    d = spark.range(1).select(st(cur).alias("c"), st(prev).alias("p"))
    return d.select(U.piotroski(F.col("c"), F.col("p")).alias("pio"), U.altman(F.col("c")).alias("alt")).first()


def test_piotroski_and_altman(spark):
    cur = dict(net_income=100, total_assets=1000, ocf=150, total_debt=200, current_assets=300, current_liabilities=150, shares=10, gross_profit=450, revenue=1000,
               retained_earnings=300, ebit=150, total_liabilities=500, equity=500)
    prev = dict(net_income=50, total_assets=1000, total_debt=300, current_assets=280, current_liabilities=160, shares=10, gross_profit=400, revenue=900)
    r = health(spark, cur, prev)
    assert r["pio"]["score"] == 9
    assert r["alt"]["z_score"] == pytest.approx(1.2 * .15 + 1.4 * .3 + 3.3 * .15 + .6 * 1 + 1.0) and r["alt"]["zone"] == "grey"
    worse = health(spark, {**cur, "ocf": 90, "shares": 11}, prev)["pio"]
    assert worse["score"] == 7 and worse["accruals"] is False and worse["no_dilution"] is False
    assert health(spark, {**cur, "ocf": None}, prev)["pio"] is None and health(spark, {**cur, "total_liabilities": 0}, prev)["alt"] is None


def test_year_extremes_read_no_year_per_bar(spark):
    """Lowest and highest close of 252 bars from steps of 6, 7 and 6: the same values, no frame beyond 14 bars."""
    assert np.prod(T.EXTREME_STEPS) == T.TRADING_DAYS
    data = {t: series(n, seed) for t, n, seed in (("A", 700, 1), ("B", 252, 2), ("C", 9, 3))}
    d = T.bar_features(frame(spark, data))
    got = {(r["ticker"], r["session"]): (r["week52_low"], r["week52_high"]) for r in d.collect()}
    for t, (ds, cs) in data.items():
        for i in range(1, len(cs)):
            year = cs[max(0, i - 251):i + 1]
            assert got[t, ds[i]] == (min(year), max(year))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    frames = [int(x) for x in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", plan)]
    assert frames and max(frames) < T.RSI_BARS
