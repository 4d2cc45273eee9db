"""Scalar functions on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorlake.functions import dates as D, numeric as N, payload as P, text as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("v,best,worst,want", [
    (10.0, 10, 40, 100.0), (40.0, 10, 40, 0.0), (25.0, 10, 40, 50.0), (5.0, 10, 40, 100.0), (99.0, 10, 40, 0.0),
    (None, 10, 40, 50.0), (float("nan"), 10, 40, 50.0), (float("inf"), 10, 40, 50.0), (0.3, 0.3, 0.3, 50.0), (0.10, 0.25, -0.05, 50.0)])
def test_linear(spark, v, best, worst, want):
    assert one(spark, N.linear(lit(v), best, worst)) == pytest.approx(want)


def test_guards(spark):
    assert one(spark, N.non_negative(lit(-1.0))) is None and one(spark, N.non_negative(lit(0.0))) == 0.0
    assert one(spark, N.pct_change(lit(5.0), lit(-10.0))) == pytest.approx(1.5)
    assert one(spark, N.pct_change(lit(5.0), lit(0.0))) is None
    assert one(spark, N.cagr_2y(lit(121.0), lit(100.0))) == pytest.approx(0.1)
    assert one(spark, N.cagr_2y(lit(121.0), lit(-100.0))) is None
    assert one(spark, N.peg(lit(20.0), lit(0.10))) == pytest.approx(2.0)
    assert one(spark, N.peg(lit(20.0), lit(1.5))) is None and one(spark, N.peg(lit(20.0), lit(-0.1))) is None
    assert one(spark, N.sanitize_yield(lit(5.4))) == pytest.approx(0.054) and one(spark, N.sanitize_yield(lit(0.0))) == 0.0
    assert one(spark, N.share_norm(lit(45.0))) == pytest.approx(0.45) and one(spark, N.share_norm(lit(1.2))) == 1.2
    assert one(spark, N.log10_positive(lit(0.0))) is None and one(spark, N.log10_positive(lit(1e9))) == pytest.approx(9)
    assert one(spark, N.finite_number(F.lit("true"))) is None and one(spark, N.finite_number(F.lit("1.5"))) == 1.5
    assert one(spark, N.margin_improving(lit(5.0), lit(10.0), lit(4.0), lit(10.0))) is True
    assert one(spark, N.margin_improving(lit(5.0), lit(10.0), lit(5.0), lit(10.0))) is False
    assert one(spark, N.margin_improving(lit(None), lit(10.0), lit(5.0), lit(10.0))) is None
    assert one(spark, N.eps_acceleration(lit(3.0), lit(2.0), lit(1.0))) == pytest.approx(-0.5)


def test_shift_weight_keeps_sum():
    w = N.shift_weight({"a": 0.5, "b": 0.3, "c": 0.2}, "a", 0.1)
    assert w["a"] == pytest.approx(0.6) and sum(w.values()) == pytest.approx(1) and w["b"] / w["c"] == pytest.approx(1.5)
    with pytest.raises(ValueError):
        N.shift_weight({"a": 0.5, "b": 0.5}, "a", 0.6)


def day(y, m, d):
    return F.lit(dt.date(y, m, d))


def test_snapshot_dates_clamp_is_sticky(spark):
    got = one(spark, D.snapshot_dates(day(2024, 5, 31), day(2023, 8, 1), 3))
    assert got == [dt.date(2023, 8, 29), dt.date(2023, 11, 29), dt.date(2024, 2, 29), dt.date(2024, 5, 31)]
    assert one(spark, D.snapshot_dates(day(2024, 5, 31), day(2024, 5, 31), 3)) == [dt.date(2024, 5, 31)]
    assert len(one(spark, D.snapshot_dates(day(2024, 1, 15), day(2004, 1, 15), 3))) == 81
    with pytest.raises(ValueError):
        D.snapshot_dates(day(2024, 5, 31), day(2023, 8, 1), 0)


def test_quarters(spark):
    assert one(spark, D.quarter_end(day(2024, 2, 10))) == dt.date(2024, 3, 31)
    assert one(spark, D.prev_quarter_end(day(2024, 3, 31))) == dt.date(2023, 12, 31)
    assert one(spark, D.latest_available_quarter(day(2024, 5, 30), 60)) == dt.date(2024, 3, 31)
    assert one(spark, D.latest_available_quarter(day(2024, 5, 29), 60)) == dt.date(2023, 12, 31)
    assert one(spark, D.latest_available_quarter(day(2000, 1, 15), 60)) is None
    assert D.months_to_days(6) == 183 and D.months_to_days(12) == 366


def test_session_clock(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert str(one(spark, D.session_close(day(2024, 7, 1)))) == "2024-07-01 20:00:00"
    assert str(one(spark, D.session_close(day(2024, 1, 2)))) == "2024-01-02 21:00:00"
    assert one(spark, D.session_open(ts("2024-07-01 15:00:00"), ts("2024-07-01 19:59:00"))) is True
    assert one(spark, D.session_open(ts("2024-07-01 15:00:00"), ts("2024-07-01 20:00:00"))) is False
    assert str(one(spark, D.quote_instant(F.lit("1719846000")))) == "2024-07-01 15:00:00"
    assert str(one(spark, D.quote_instant(F.lit("2024-07-01T15:00:00Z")))) == "2024-07-01 15:00:00"
    assert one(spark, D.quote_instant(F.lit("soon"))) is None and one(spark, D.quote_instant(F.lit("nan"))) is None


def test_text(spark):
    for t, region, base, suffix in [("SAP.DE", "eu", "SAP", "DE"), ("7203.T", "asia", "7203", "T"), ("BRK.B", "us", "BRK", "B"), ("aapl", "us", "AAPL", "")]:
        assert one(spark, X.infer_region(F.lit(t))) == region
        assert (one(spark, X.split_base(F.lit(t))), one(spark, X.split_suffix(F.lit(t)))) == (base, suffix)
    assert one(spark, X.norm_symbol(F.lit(" brk.b "))) == "BRK-B"
    assert one(spark, X.compact_text(lit(416161000000.0))) == "416.2B" and one(spark, X.compact_text(lit(-1500.0))) == "-1.5K"
    assert one(spark, X.usd_text(lit(2.5e6))) in ("$2M", "$3M") and one(spark, X.usd_text(lit(1.26e9))) == "$1.3B"
    assert one(spark, X.growth_note(lit(0.25), lit(None))) == "earnings growth of 25.0%"
    assert one(spark, X.growth_note(lit(38.45), lit(0.467))).startswith("earnings growth of +46.7% a year over 2 years (+3845.0%")
    assert one(spark, X.growth_note(lit(38.45), lit(None))).endswith("(inflated by an unusually low prior year)")
    assert one(spark, X.search_variants(F.lit("ExxonMobil Holdings, Corp."))) == ["ExxonMobil Holdings Corp", "ExxonMobil", "Exxon"]
    assert one(spark, X.search_variants(F.lit("AB Inc"))) == ["AB Inc"]
    assert one(spark, X.breakdown_text(lit(50.5), lit(51.5))) == "50 / 52"


def test_payload(spark):
    pct = one(spark, P.percent_form(F.create_map(F.lit("roe"), F.lit(40.0), F.lit("growth"), F.lit(0.2)), ["roe"]))
    assert pct == {"roe": 0.4, "growth": 0.2}


def test_compact_texts_round_as_printf_does(spark):
    """Ties go to the even digit and by the exact binary value, as in the SQL twins."""
    values = [214.5e6, 215.5e6, 4.5e6, 1.25e9, 1.35e9, 1.15e9, 1.45e9, 2.05e9, 9.95e9, 1.75e9, 999.95e9]
    d = spark.createDataFrame([(v,) for v in values + [-v for v in values]], "v double")
    for r in d.select("v", X.usd_text("v").alias("usd")).collect():
        x = r["v"]
        assert r["usd"] == (f"${x / 1e9:.1f}B" if abs(x) >= 1e9 else f"${x / 1e6:.0f}M"), x
    shares = [0.125, 0.0025, 0.1235, 0.1225, 0.0005, 0.0015, 0.99950001, -0.0025, 0.0, 1e-9, float("nan")]
    d = spark.createDataFrame([(v,) for v in shares], "v double")
    for r in d.select("v", X.percent_text("v").alias("one"), X.percent_text("v", 0).alias("none")).collect():
        x = r["v"] * 100.0
        assert x != x or (r["one"], r["none"]) == (f"{x:.1f}%", f"{x:.0f}%"), x
