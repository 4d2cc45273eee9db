"""Factor models on hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from factorlake.operators import scoring as S

FIELDS = ["trailing_pe", "price_to_book", "peg_ratio", "return_on_equity", "return_on_assets", "profit_margin", "earnings_growth", "earnings_cagr_2y",
          "revenue_growth", "asset_growth", "debt_to_equity", "current_ratio", "free_cashflow", "market_cap", "eps_surprise", "price_vs_sma200", "return_1m",
          "return_3m", "return_6m", "return_12m", "sma200_slope", "rsi_14", "macd_histogram", "volatility_1y", "beta_3y", "expense_ratio", "total_assets",
          "three_year_return", "five_year_return", "sharpe_proxy", "yield"]
FLAGS = ["margin_improving", "roa_improving"]


def row(spark, asset_type="STOCK", **v):
    schema = "asset_type string, " + ", ".join(f"{f} double" for f in FIELDS) + ", " + ", ".join(f"{f} boolean" for f in FLAGS)
    return spark.createDataFrame([(asset_type, *[v.get(f) for f in FIELDS], *[v.get(f) for f in FLAGS])], schema)


STRONG = dict(trailing_pe=10.0, price_to_book=1.0, peg_ratio=0.8, return_on_equity=0.35, return_on_assets=0.2, profit_margin=0.3, earnings_growth=0.3,
              revenue_growth=0.25, asset_growth=-0.05, debt_to_equity=10.0, current_ratio=3.0, free_cashflow=20.0, market_cap=100.0, eps_surprise=20.0,
              price_vs_sma200=0.2, return_1m=0.0, return_12m=0.5, sma200_slope=0.2, rsi_14=30.0, macd_histogram=0.1, margin_improving=True, roa_improving=True)


def test_empty_row_is_neutral(spark):
    r = S.score_assets(row(spark)).first()
    assert r["total"] == pytest.approx(50.0) and set(r["breakdown"].values()) == {50.0}
    assert r["rationale"] == [S.NO_EPS_NOTE]
    assert S.score_assets(row(spark), "classic").first()["rationale"] == [S.EMPTY_NOTE]


def test_strong_row_scores_full(spark):
    assert S.score_assets(row(spark, **STRONG)).first()["total"] == pytest.approx(100.0)
    classic = S.score_assets(row(spark, **STRONG), "classic").first()
    assert classic["total"] == pytest.approx(0.35 * 100 + 0.25 * 100 + 0.20 * (45 + 25 + 24) + 0.20 * 100)


def test_one_red_flag_caps_at_neutral(spark):
    bad = {**STRONG, "earnings_growth": -0.5, "revenue_growth": -0.5}
    r = S.score_assets(row(spark, **bad)).first()
    assert r["total"] == 50.0 and r["rationale"][0] == S.CAPPED_NOTE and "growth flagged as disqualifying" in r["rationale"]
    assert S.score_assets(row(spark, **bad), enforce_cap=False).first()["total"] == pytest.approx(82.0)


def test_negative_multiples_are_missing_not_cheap(spark):
    neg = S.score_quant(row(spark, trailing_pe=-5.0, price_to_book=-1.0, peg_ratio=-2.0)).first()
    assert neg["f_value"] == pytest.approx(50.0)


def test_momentum_excludes_last_month_and_technical_blend(spark):
    d = row(spark, return_12m=0.21, return_1m=0.10)
    assert d.select(S.quant_momentum().alias("v")).first()["v"] == pytest.approx(0.35 * 50 + 0.40 * (0.1 + 0.2) / 0.5 * 100 + 0.25 * 50)
    t = row(spark, rsi_14=10.0, macd_histogram=0.0).select(S.technical().alias("v")).first()["v"]
    assert t == pytest.approx(100 * 0.375 + 50 * 0.625)


def test_improvement_uses_known_flags(spark):
    get = lambda **k: row(spark, **k).select(S.improvement().alias("v")).first()["v"]
    assert (get(), get(margin_improving=True), get(margin_improving=True, roa_improving=False)) == (50.0, 100.0, 50.0)


def test_fund_models(spark):
    d = row(spark, "ETF", return_1m=0.08, return_3m=0.2, return_6m=0.3, return_12m=0.5, volatility_1y=0.10, beta_3y=0.5, expense_ratio=0.03, total_assets=1e12)
    r = S.score_assets(d).first()
    assert r["total"] == pytest.approx(100.0) and r["breakdown"]["risk"] == 100.0
    risky = S.score_assets(row(spark, "ETF", return_1m=0.08, return_3m=0.2, return_6m=0.3, return_12m=0.5, volatility_1y=0.9, beta_3y=3.0)).first()
    assert risky["total"] == 50.0 and "risk flagged as disqualifying" in risky["rationale"]
    assert S.score_etf_quant(row(spark, "ETF")).first()["f_cost"] == 60.0
    c = S.score_etf_classic(row(spark, "ETF", three_year_return=0.15, five_year_return=0.12, return_12m=0.2, sharpe_proxy=1.5, volatility_1y=0.1, total_assets=1e11, expense_ratio=0.03, **{"yield": 0.04})).first()
    assert c["total"] == pytest.approx(100.0)


def test_variants_equal_the_scorer(spark):
    d = S.quant_factors(row(spark, **{**STRONG, "earnings_growth": -0.04, "revenue_growth": -0.02})).withColumn("candidates", F.create_map(F.lit("x"), F.lit(0.0)))
    real = S.score_quant(row(spark, **{**STRONG, "earnings_growth": -0.04, "revenue_growth": -0.02})).first()["total"]
    vs = [S.variant("baseline", tilt=0.0, candidate=""), S.variant("none", cap="none", tilt=0.0, candidate=""), S.variant("x10", cap="none", tilt=0.10, candidate="x"),
          S.variant("missing", cap="none", tilt=0.10, candidate="y"), S.variant("no_growth", cap="no_growth", tilt=0.0, candidate="")]
    got = {r["variant"]: r["total"] for r in S.score_variants(d, vs).collect()}
    assert got["baseline"] == pytest.approx(real, abs=1e-9) and real == 50.0
    assert got["x10"] == pytest.approx(got["none"] * 0.9) and got["missing"] == pytest.approx(got["none"] * 0.9 + 5.0)
    assert got["no_growth"] == pytest.approx(got["none"])
    assert len(S.weight_variants()) == 16 and all(sum(v[f"w_{f}"] for f in S.QUANT_WEIGHTS) == pytest.approx(1) for v in S.weight_variants())


def test_risk_tilt(spark):
    get = lambda t, s, p: spark.range(1).select(S.risk_tilt(F.lit(t), F.lit(s).cast("string"), p).alias("v")).first()["v"]
    assert get(98.0, "Utilities", "conservative") == 100.0 and get(2.0, "Technology", "conservative") == 0.0
    assert get(70.0, None, "conservative") == 50.0 and get(70.0, "Energy", "conservative") == 70.0
    assert get(70.0, "Technology", "aggressive") == 75.0 and get(70.0, "Utilities", "moderate") == 70.0
