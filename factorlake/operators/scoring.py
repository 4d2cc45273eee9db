"""Factor models as column expressions.  Weights and cap rules are data, so any number of variants
is scored in the same pass by exploding an array of variant structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric as N, text as X
from .technicals import momentum_12_1

# Published model weights.
CLASSIC_WEIGHTS = {"quality": 0.35, "value": 0.25, "health": 0.20, "trend": 0.20}
QUANT_WEIGHTS = {"value": 0.225, "growth": 0.18, "profitability": 0.225, "momentum": 0.135,
                 "eps_revisions": 0.135, "asset_growth": 0.10}
ETF_WEIGHTS = {"returns": 0.40, "risk_adj": 0.25, "size": 0.15, "cost_yield": 0.20}
ETF_QUANT_WEIGHTS = {"momentum": 0.65, "risk": 0.15, "cost": 0.12, "liquidity": 0.08}
# Factor levels below which the total is capped at neutral.
SOFT_LIMIT, HARD_LIMIT = 20.0, 15.0
RELAXED_SOFT, RELAXED_HARD = 10.0, 5.0
ETF_RISK_LIMIT, ETF_COST_LIMIT = 20.0, 15.0
NEUTRAL = 50.0

CAPPED_NOTE = "Disqualifying factor(s) capped score at neutral"
EMPTY_NOTE = "Limited data available; score based on neutral defaults."
NO_EPS_NOTE = "EPS surprise data unavailable"

lin = N.linear
c = F.col


def mix(*terms: tuple[Column, float]) -> Column:
    total = None
    for score, weight in terms:
        part = score * F.lit(weight)
        total = part if total is None else total + part
    return total


# ---- shared pieces ---------------------------------------------------------------------------

def technical() -> Column:
    rsi = F.greatest(c("rsi_14"), F.lit(20.0))
    rsi = F.when(c("rsi_14").isNotNull(), rsi)
    return mix((lin(rsi, 35.0, 65.0), 0.375), (lin("macd_histogram", 0.05, -0.05), 0.625))


def _technical_notes() -> list[Column]:
    return [F.when(c("rsi_14") < 30, F.format_string("RSI %.1f (below 30)", c("rsi_14"))),
            F.when(c("macd_histogram") > 0, F.lit("MACD histogram positive"))]


def _valuation() -> tuple[Column, Column, Column]:
    return (lin(N.non_negative("trailing_pe"), 10, 40), lin(N.non_negative("price_to_book"), 1.0, 6.0),
            lin(N.non_negative("peg_ratio"), 0.8, 3.0))


def _valuation_notes() -> list[Column]:
    pe, peg = c("trailing_pe"), c("peg_ratio")
    return [F.when((pe >= 0) & (pe < 20), F.format_string("P/E of %.1f", pe)),
            F.when((peg >= 0) & (peg < 1.5), F.format_string("PEG of %.2f", peg))]


def _trend_parts() -> tuple[Column, Column]:
    return lin("price_vs_sma200", 0.15, -0.20), lin("sma200_slope", 0.10, -0.10)


def fcf_yield() -> Column:
    return N.ratio_pos("free_cashflow", "market_cap")


# ---- six-factor model ------------------------------------------------------------------------

def quant_value() -> Column:
    pe, pb, peg = _valuation()
    return mix((pe, 0.35), (pb, 0.20), (peg, 0.25), (lin(fcf_yield(), 0.10, 0.0), 0.20))


def quant_growth() -> Column:
    return mix((lin("earnings_growth", 0.25, -0.05), 0.55), (lin("revenue_growth", 0.20, -0.05), 0.45))


def improvement() -> Column:
    m, r = c("margin_improving"), c("roa_improving")
    score = lambda b: F.when(b, 100.0).otherwise(0.0)
    return (F.when(m.isNotNull() & r.isNotNull(), (score(m) + score(r)) / 2.0)
            .when(m.isNotNull(), score(m)).when(r.isNotNull(), score(r)).otherwise(NEUTRAL))


def quant_profitability() -> Column:
    return mix((lin("return_on_equity", 0.30, 0.05), 0.30), (lin("profit_margin", 0.25, 0.02), 0.25),
               (lin("return_on_assets", 0.15, 0.01), 0.15), (improvement(), 0.30))


def quant_momentum() -> Column:
    pvs, slope = _trend_parts()
    r = momentum_12_1(c("return_12m"), c("return_1m"))
    return mix((pvs, 0.35), (lin(r, 0.30, -0.20), 0.40), (slope, 0.25))


def quant_eps() -> Column:
    return lin("eps_surprise", 15.0, -15.0)


def quant_asset_growth() -> Column:
    return lin("asset_growth", -0.05, 0.30)


def quant_factors(df: DataFrame, technical_flag: bool = True) -> DataFrame:
    """Adds ``f_<factor>`` for the six factors (momentum blends 30 % of the technical score)."""
    momentum = quant_momentum()
    if technical_flag:
        momentum = mix((momentum, 0.70), (technical(), 0.30))
    return (df.withColumn("f_value", quant_value()).withColumn("f_growth", quant_growth())
            .withColumn("f_profitability", quant_profitability()).withColumn("f_momentum", momentum)
            .withColumn("f_eps_revisions", quant_eps()).withColumn("f_asset_growth", quant_asset_growth()))


def weighted_total(weights: dict[str, float] | Callable[[str], Column], factors: list[str]) -> Column:
    total = None
    for f in factors:
        w = F.lit(weights[f]) if isinstance(weights, dict) else weights(f)
        part = c(f"f_{f}") * w
        total = part if total is None else total + part
    return total


def disqualified(mode: Column | str = "full") -> Column:
    """Red-flag gate over the ``f_*`` columns; ``mode`` is full, soft, none, no_growth or no_value."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    soft = F.when(m == "soft", RELAXED_SOFT).otherwise(SOFT_LIMIT)
    hard = F.when(m == "soft", RELAXED_HARD).otherwise(HARD_LIMIT)
    hit = ((c("f_growth") < soft) & (m != "no_growth")) | (c("f_momentum") < soft) | (c("f_eps_revisions") < soft) \
        | ((c("f_value") < hard) & (m != "no_value")) | (c("f_profitability") < hard)
    return hit & (m != "none")


def capped(total: Column, flag: Column) -> Column:
    return F.when(flag, F.least(total, F.lit(NEUTRAL))).otherwise(total)


def score_quant(df: DataFrame, technical_flag: bool = True, enforce_cap: bool = True,
                weights: dict[str, float] | None = None) -> DataFrame:
    d = quant_factors(df, technical_flag)
    flag = disqualified("full" if enforce_cap else "none")
    total = weighted_total(weights or QUANT_WEIGHTS, list(QUANT_WEIGHTS))
    return d.withColumn("disqualified", flag).withColumn("total", capped(total, c("disqualified")))


def quant_rationale(technical_flag: bool = True) -> Column:
    """Ordered notes for a row scored by ``score_quant``."""
    fy = fcf_yield()
    on = c("disqualified")
    hit = lambda f, limit, text: F.when(on & (c(f) < limit), F.lit(text))
    r = momentum_12_1(c("return_12m"), c("return_1m"))
    es, ag = c("eps_surprise"), c("asset_growth")
    value = _valuation_notes() + [F.when(lin(fy, 0.10, 0.0) > 70, F.concat(F.lit("free cash flow yield "), X.percent_text(fy))),
                                  hit("f_value", HARD_LIMIT, "valuation flagged as disqualifying")]
    growth = [F.when(c("earnings_growth") > 0.10, X.growth_note("earnings_growth", "earnings_cagr_2y")),
              F.when(c("revenue_growth") > 0.08, F.concat(F.lit("revenue growth of "), X.percent_text("revenue_growth"))),
              hit("f_growth", SOFT_LIMIT, "growth flagged as disqualifying")]
    profit = [F.when(c("return_on_equity") > 0.15, F.concat(F.lit("ROE of "), X.percent_text("return_on_equity"))),
              F.when(c("profit_margin") > 0.15, F.concat(F.lit("profit margin of "), X.percent_text("profit_margin"))),
              F.when(c("margin_improving") & c("roa_improving"), F.lit("margin and ROA expanding YoY")),
              hit("f_profitability", HARD_LIMIT, "profitability flagged as disqualifying")]
    mom = [F.when(r > 0.10, F.concat(F.lit("12-1 momentum return of "), X.percent_text(r))),
           F.when(c("price_vs_sma200") > 0, F.format_string("trading %.1f%% above 200d SMA", c("price_vs_sma200") * 100.0))]
    mom += (_technical_notes() if technical_flag else []) + [hit("f_momentum", SOFT_LIMIT, "momentum flagged as disqualifying")]
    eps = [F.when(es.isNull(), F.lit(NO_EPS_NOTE)).when(es > 5, F.format_string("EPS vs. estimates: +%.1f%% on average", es))
           .when(es < -5, F.format_string("EPS vs. estimates: %.1f%% on average", es)),
           hit("f_eps_revisions", SOFT_LIMIT, "EPS revisions flagged as disqualifying")]
    assets = [F.when(ag <= 0.02, F.concat(F.lit("asset base "), X.signed_percent_text(ag), F.lit(" YoY")))]
    return _with_default(X.notes(F.when(on, F.lit(CAPPED_NOTE)), *value, *growth, *profit, *mom, *eps, *assets))


def _with_default(notes: Column) -> Column:
    return F.when(F.size(notes) == 0, F.array(F.lit(EMPTY_NOTE))).otherwise(notes)


# ---- four-pillar model -----------------------------------------------------------------------

def leverage() -> Column:
    return F.when(c("debt_to_equity") >= 0, c("debt_to_equity") / 100.0)


def score_classic(df: DataFrame, technical_flag: bool = False) -> DataFrame:
    pe, pb, peg = _valuation()
    pvs, slope = _trend_parts()
    r12 = lin("return_12m", 0.30, -0.20)
    fcf = F.when(c("free_cashflow") > 0, 80.0).when(c("free_cashflow").isNotNull(), 20.0).otherwise(NEUTRAL)
    quality = mix((lin("return_on_equity", 0.30, 0.05), 0.35), (lin("profit_margin", 0.25, 0.02), 0.25),
                  (lin("earnings_growth", 0.25, -0.05), 0.25), (lin("revenue_growth", 0.20, -0.05), 0.15))
    health = mix((lin(leverage(), 0.2, 2.0), 0.45), (lin("current_ratio", 2.5, 1.0), 0.25), (fcf, 0.30))
    trend = (mix((pvs, 0.20), (r12, 0.20), (slope, 0.20), (technical(), 0.40)) if technical_flag
             else mix((pvs, 0.35), (r12, 0.30), (slope, 0.35)))
    d = (df.withColumn("f_quality", quality).withColumn("f_value", mix((pe, 0.45), (pb, 0.20), (peg, 0.35)))
         .withColumn("f_health", health).withColumn("f_trend", trend))
    return d.withColumn("total", weighted_total(CLASSIC_WEIGHTS, list(CLASSIC_WEIGHTS)))


def classic_rationale(technical_flag: bool = False) -> Column:
    de = leverage()
    quality = [F.when(c("return_on_equity") > 0.15, F.concat(F.lit("ROE of "), X.percent_text("return_on_equity"))),
               F.when(c("profit_margin") > 0.15, F.concat(F.lit("profit margin of "), X.percent_text("profit_margin"))),
               F.when(c("earnings_growth") > 0.10, X.growth_note("earnings_growth", "earnings_cagr_2y"))]
    health = [F.when(de < 0.5, F.format_string("leverage D/E=%.2f", de)),
              F.when(c("free_cashflow") > 0, F.lit("positive free cash flow"))]
    trend = _technical_notes() if technical_flag else []
    trend += [F.when(c("price_vs_sma200") > 0, F.format_string("trading %.1f%% above 200d SMA", c("price_vs_sma200") * 100.0)),
              F.when(c("return_12m") > 0.10, F.concat(F.lit("12-month return of "), X.percent_text("return_12m")))]
    return _with_default(X.notes(*quality, *_valuation_notes(), *health, *trend))


# ---- funds -----------------------------------------------------------------------------------

def score_etf_classic(df: DataFrame) -> DataFrame:
    aum = N.log10_positive("total_assets")
    d = (df
         .withColumn("f_returns", mix((lin("three_year_return", 0.15, 0.0), 0.35), (lin("five_year_return", 0.12, 0.0), 0.40),
                                      (lin("return_12m", 0.20, -0.10), 0.25)))
         .withColumn("f_risk_adj", mix((lin("sharpe_proxy", 1.5, -0.5), 0.70), (lin("volatility_1y", 0.10, 0.40), 0.30)))
         .withColumn("f_size", lin(aum, 11.0, 8.0))
         .withColumn("f_cost_yield", mix((lin("expense_ratio", 0.03, 0.75, 60.0), 0.65), (lin("yield", 0.04, 0.0), 0.35))))
    return d.withColumn("total", weighted_total(ETF_WEIGHTS, list(ETF_WEIGHTS)))


def score_etf_quant(df: DataFrame) -> DataFrame:
    aum = N.log10_positive("total_assets")
    d = (df
         .withColumn("f_momentum", mix((lin("return_1m", 0.08, -0.12), 0.15), (lin("return_3m", 0.20, -0.25), 0.25),
                                       (lin("return_6m", 0.30, -0.35), 0.30), (lin("return_12m", 0.50, -0.40), 0.30)))
         .withColumn("f_risk", mix((lin("volatility_1y", 0.10, 0.70), 0.50), (lin("beta_3y", 0.5, 2.5, 60.0), 0.50)))
         .withColumn("f_cost", lin("expense_ratio", 0.03, 1.50, 60.0))
         .withColumn("f_liquidity", lin(aum, 12.0, 8.0)))
    flag = (c("f_risk") < ETF_RISK_LIMIT) | (c("f_cost") < ETF_COST_LIMIT)
    total = weighted_total(ETF_QUANT_WEIGHTS, list(ETF_QUANT_WEIGHTS))
    return d.withColumn("disqualified", flag).withColumn("total", capped(total, c("disqualified")))


def _aum_note() -> Column:
    return F.when(c("total_assets") >= 10_000_000_000, F.format_string("AUM $%.1fB", c("total_assets") / 1e9))


def etf_classic_rationale() -> Column:
    return _with_default(X.notes(
        F.when(c("five_year_return") > 0.08, F.concat(F.lit("5y avg return "), X.percent_text("five_year_return"))),
        F.when(c("three_year_return") > 0.10, F.concat(F.lit("3y avg return "), X.percent_text("three_year_return"))),
        F.when(c("sharpe_proxy") > 0.8, F.format_string("Sharpe≈%.2f", c("sharpe_proxy"))),
        F.when(c("volatility_1y") < 0.15, F.concat(F.lit("1y volatility "), X.percent_text("volatility_1y"))),
        _aum_note(),
        F.when(c("expense_ratio") < 0.001, F.concat(F.lit("expense ratio "), X.percent_text("expense_ratio", 2))),
        F.when(c("yield") > 0.02, F.concat(F.lit("dividend yield "), X.percent_text("yield", 2)))))


def etf_quant_rationale() -> Column:
    er = c("expense_ratio")
    flagged = c("disqualified")
    return _with_default(X.notes(
        F.when(flagged, F.lit(CAPPED_NOTE)),
        F.when(c("return_12m") > 0.30, F.concat(F.lit("1y return of "), X.percent_text("return_12m"))),
        F.when(c("return_6m") > 0.20, F.concat(F.lit("6m return of "), X.percent_text("return_6m"))),
        F.when(c("volatility_1y") < 0.15, F.concat(F.lit("1y volatility "), X.percent_text("volatility_1y"))),
        F.when(c("beta_3y") < 0.8, F.format_string("beta %.2f", c("beta_3y"))),
        F.when(c("f_risk") < ETF_RISK_LIMIT, F.lit("risk flagged as disqualifying")),
        F.when(er < 0.10, F.format_string("expense ratio %.2f%%", er)).when(er > 1.0, F.format_string("high expense ratio (%.2f%%)", er)),
        F.when(c("f_cost") < ETF_COST_LIMIT, F.lit("cost flagged as disqualifying")),
        _aum_note()))


# ---- dispatch --------------------------------------------------------------------------------

STOCK_MODELS: dict[str, Callable[..., DataFrame]] = {"quant": score_quant, "classic": score_classic}
ETF_MODELS: dict[str, Callable[..., DataFrame]] = {"quant": score_etf_quant, "classic": score_etf_classic}
BREAKDOWN = {("STOCK", "quant"): list(QUANT_WEIGHTS), ("STOCK", "classic"): list(CLASSIC_WEIGHTS),
             ("ETF", "quant"): list(ETF_QUANT_WEIGHTS), ("ETF", "classic"): list(ETF_WEIGHTS)}


def uses_technical(flag: bool | None, model: str) -> bool:
    """Unset means on for the six-factor model, off for the four-pillar one."""
    return model == "quant" if flag is None else flag


def _outcome(d: DataFrame, kind: str, model: str, rationale: Column) -> Column:
    """Total, breakdown and rationale of a scored row as one struct."""
    value = (lambda n: F.bround(F.col(f"f_{n}"), 1)) if (kind, model) == ("ETF", "quant") else (lambda n: F.col(f"f_{n}"))
    pairs = [x for n in BREAKDOWN[(kind, model)] for x in (F.lit(n), value(n))]
    return F.struct(F.col("total").alias("total"), rationale.alias("rationale"), F.create_map(*pairs).alias("breakdown"))


def score_assets(df: DataFrame, model: str = "quant", technical_flag: bool | None = None,
                 enforce_cap: bool = True) -> DataFrame:
    """Scores stocks and funds of one table: adds total, breakdown map and rationale array.

    Both models are evaluated as expressions over the same rows, so the input is read once.
    """
    tech = uses_technical(technical_flag, model)
    if model == "quant":
        s = score_quant(df, tech, enforce_cap)
        s = s.select(*df.columns, _outcome(s, "STOCK", model, quant_rationale(tech)).alias("_stock"))
        f = score_etf_quant(s)
        both = f.select(*df.columns, "_stock", _outcome(f, "ETF", model, etf_quant_rationale()).alias("_fund"))
    else:
        s = score_classic(df, tech)
        s = s.select(*df.columns, _outcome(s, "STOCK", model, classic_rationale(tech)).alias("_stock"))
        f = score_etf_classic(s)
        both = f.select(*df.columns, "_stock", _outcome(f, "ETF", model, etf_classic_rationale()).alias("_fund"))
    d = both.withColumn("_o", F.when(F.col("asset_type") == "ETF", F.col("_fund")).otherwise(F.col("_stock")))
    return d.select(*df.columns, "_o.total", "_o.rationale", "_o.breakdown")


# ---- tilts, variants, candidates -------------------------------------------------------------

def explode_variants(df: DataFrame, variants: list[dict]) -> DataFrame:
    """One row per asset and variant.  The variant list travels as an array literal in the plan."""
    keys = sorted({k for v in variants for k in v})
    def struct(v):
        return F.struct(*[F.lit(v.get(k)).alias(k) for k in keys])
    return df.withColumn("variant", F.explode(F.array(*[struct(v) for v in variants])))


def score_variants(df: DataFrame, variants: list[dict]) -> DataFrame:
    """Totals for weight / cap / tilt variants over rows that carry the ``f_*`` factors.

    A variant has ``name``, ``cap`` and ``w_<factor>``; with ``tilt`` and ``candidate`` the weights
    shrink by (1 - tilt) and the candidate's score enters with ``tilt``.
    """
    d = explode_variants(df, variants)
    v = F.col("variant")
    tilted = any("tilt" in x for x in variants)
    keep = F.lit(1.0) - v["tilt"] if tilted else F.lit(1.0)
    total = weighted_total(lambda f: v[f"w_{f}"] * keep, list(QUANT_WEIGHTS))
    if tilted:
        score = F.coalesce(F.try_element_at(F.col("candidates"), v["candidate"]), F.lit(NEUTRAL))
        total = total + F.when(v["tilt"] > 0, score * v["tilt"]).otherwise(0.0)
    return d.withColumn("total", capped(total, disqualified(v["cap"]))).withColumn("variant", v["name"])


def variant(name: str, weights: dict[str, float] = QUANT_WEIGHTS, cap: str = "full", **extra) -> dict:
    return {"name": name, "cap": cap, **{f"w_{f}": float(weights.get(f, 0.0)) for f in QUANT_WEIGHTS}, **extra}


def weight_variants() -> list[dict]:
    """Baseline, each factor five points down and up, three factors ten points up."""
    out = [variant("baseline")]
    for f in QUANT_WEIGHTS:
        for delta in (-0.05, 0.05):
            out.append(variant(f"{f} {delta:+.0%}", N.shift_weight(QUANT_WEIGHTS, f, delta)))
    for f in ("momentum", "value", "profitability"):
        out.append(variant(f"{f} +10pp", N.shift_weight(QUANT_WEIGHTS, f, 0.10)))
    return out


def cap_variants(weights: dict[str, float] = QUANT_WEIGHTS) -> list[dict]:
    """Cap rules, and momentum taken from the revisions weight, alone and with the relaxed cap."""
    def moved(step: float) -> dict[str, float]:
        return {**weights, "momentum": weights["momentum"] + step, "eps_revisions": weights["eps_revisions"] - step}
    modes = {"baseline": "full", "cap-none": "none", "cap-soft": "soft", "cap-no-growth": "no_growth", "cap-no-value": "no_value"}
    return ([variant(n, weights, m) for n, m in modes.items()]
            + [variant("A-soft", moved(0.05)), variant("A-soft2", moved(0.10)), variant("A-soft+capsoft", moved(0.05), "soft")])


# Fixed values: (best, worst) of the candidate signals.
CANDIDATES = {
    "accruals": (-0.10, 0.10), "gross_prof": (0.50, 0.05), "asset_growth": (-0.05, 0.30), "net_issuance": (-0.02, 0.10),
    "ocf_ni": (2.0, 0.5), "interest_cov": (10.0, 1.5), "capex_int": (0.02, 0.15), "roic": (0.25, 0.02),
    "sbc_rev": (0.01, 0.15), "net_debt_ebitda": (0.0, 4.0), "fcf_ni": (1.0, 0.3), "asset_turn": (2.0, 0.2),
}


def candidate_values(cur: Column, prev: Column) -> dict[str, Column]:
    """Raw candidate signals from two fact structs; NULL where a denominator is not positive."""
    ta, ni, rev = cur["total_assets"], cur["net_income"], cur["revenue"]
    paid = N.ratio_pos(cur["income_tax"], cur["pretax_income"])
    rate = F.when((paid >= 0) & (paid <= 0.5), paid).otherwise(0.21)
    grow = lambda a, b: F.when(b > 0, N.ratio(a - b, b))
    return {
        "accruals": N.ratio_pos(ni - cur["ocf"], ta),
        "gross_prof": N.ratio_pos(cur["gross_profit"], ta),
        "asset_growth": grow(ta, prev["total_assets"]),
        "net_issuance": grow(cur["shares"], prev["shares"]),
        "ocf_ni": N.ratio_pos(cur["ocf"], ni),
        "interest_cov": N.ratio_pos(cur["ebit"], cur["interest_expense"]),
        "capex_int": N.ratio_pos(F.abs(cur["capex"]), ta),
        "roic": N.ratio_pos(cur["ebit"] * (F.lit(1.0) - rate), cur["equity"] + cur["total_debt"]),
        "sbc_rev": N.ratio_pos(cur["stock_comp"], rev),
        "net_debt_ebitda": N.ratio_pos(cur["total_debt"] - cur["cash"], cur["ebitda"]),
        "fcf_ni": N.ratio_pos(cur["fcf"], ni),
        "asset_turn": N.ratio_pos(rev, ta),
    }


def candidate_scores(cur: Column, prev: Column, metrics: dict[str, tuple[float, float]] = CANDIDATES) -> Column:
    """``map<name, score>``; a missing signal has a NULL score (neutral when tilting, absent in an IC)."""
    raw = candidate_values(cur, prev)
    pairs = [x for n, (best, worst) in metrics.items()
             for x in (F.lit(n), F.when(raw[n].isNotNull(), lin(raw[n], best, worst)))]
    return F.create_map(*pairs)


# Sector groups of the risk profile tilt (house taxonomy).
DEFENSIVE = ["Healthcare", "Utilities", "Consumer Defensive"]
GROWTH = ["Technology", "Financial Services", "Consumer Cyclical", "Communication Services"]


def risk_tilt(total: Column, sector: Column, profile: Column | str) -> Column:
    """Conservative favours defensives and holds unknown sectors at neutral; aggressive mirrors it."""
    p = F.lit(profile) if isinstance(profile, str) else profile
    s = F.coalesce(sector, F.lit(""))
    up, down = F.least(F.lit(100.0), total + 5), F.greatest(F.lit(0.0), total - 3)
    safe = (F.when(s.isin(DEFENSIVE), up).when(s.isin(GROWTH), down)
            .when(s.isin("", "Unknown"), F.least(total, F.lit(NEUTRAL))).otherwise(total))
    bold = F.when(s.isin(GROWTH), up).when(s.isin(DEFENSIVE), down).otherwise(total)
    return F.when(p == "conservative", safe).when(p == "aggressive", bold).otherwise(total)
