"""Statement-derived features: one derivation for fixed-lag, filing-date and live inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric as N
from ..functions.dates import latest_available_quarter
from . import asof

#: input column -> (fact, periods back)
LAGGED = {
    "ni": ("net_income", 0), "ni_prev": ("net_income", 1), "ni_prev2": ("net_income", 2),
    "rev": ("revenue", 0), "rev_prev": ("revenue", 1),
    "eps": ("eps", 0), "eps_prev": ("eps", 1), "eps_prev2": ("eps", 2),
    "gross_profit": ("gross_profit", 0), "gross_profit_prev": ("gross_profit", 1),
    "total_assets": ("total_assets", 0), "total_assets_prev": ("total_assets", 1),
    "equity": ("equity", 0), "total_debt": ("total_debt", 0),
    "curr_assets": ("current_assets", 0), "curr_liab": ("current_liabilities", 0),
    "shares": ("shares", 0), "fcf": ("fcf", 0),
}
#: parked as-filed twins of the levels a trailing-twelve-month overlay replaces
AS_FILED = {"ni": "ni_asfiled", "rev": "rev_asfiled", "eps": "eps_asfiled",
            "gross_profit": "gross_profit_asfiled", "total_assets": "total_assets_asfiled"}


def lagged_inputs(periods: Column) -> list[Column]:
    """The raw inputs read from an as-of period array, newest first."""
    return [asof.n_back(periods, n)[fact].alias(name) for name, (fact, n) in LAGGED.items()]


def derive_features(df: DataFrame) -> DataFrame:
    """Guarded ratios.  Needs the LAGGED columns, ``price`` and ``ttm_div``; twins are optional.

    Comparisons read the as-filed years, levels read the plain columns, so a trailing window is
    never compared with a fiscal year.
    """
    def filed(name: str) -> Column:
        twin = AS_FILED[name]
        return F.coalesce(F.col(twin), F.col(name)) if twin in df.columns else F.col(name)
    ni, rev, eps = filed("ni"), filed("rev"), filed("eps")
    gp, assets = filed("gross_profit"), filed("total_assets")
    price, shares = F.col("price"), F.col("shares")
    pe = N.ratio_pos(price, "eps")
    growth = N.pct_change(ni, "ni_prev")
    book = F.when((F.col("equity") > 0) & (shares > 0), N.ratio("equity", shares))
    return df.select(
        *df.columns,
        pe.alias("trailing_pe"),
        N.ratio_pos(price, book).alias("price_to_book"),
        N.peg(pe, growth).alias("peg_ratio"),
        N.ratio_pos("ni", "equity").alias("return_on_equity"),
        N.ratio_pos("ni", "total_assets").alias("return_on_assets"),
        N.ratio_pos("ni", "rev").alias("profit_margin"),
        growth.alias("earnings_growth"),
        N.cagr_2y(ni, "ni_prev2").alias("earnings_cagr_2y"),
        N.pct_change(rev, "rev_prev").alias("revenue_growth"),
        F.when(F.col("total_assets_prev") > 0,
               N.ratio(assets - F.col("total_assets_prev"), "total_assets_prev")).alias("asset_growth"),
        N.margin_improving(gp, rev, "gross_profit_prev", "rev_prev").alias("margin_improving"),
        N.roa_improving(ni, assets, "ni_prev", "total_assets_prev").alias("roa_improving"),
        (N.ratio_pos("total_debt", "equity") * 100.0).alias("debt_to_equity"),
        N.ratio_pos("curr_assets", "curr_liab").alias("current_ratio"),
        F.col("fcf").alias("free_cashflow"),
        N.ratio_pos("ttm_div", price).alias("dividend_yield"),
        F.when((F.col("ttm_div") != 0) & (F.col("eps") != 0), N.ratio("ttm_div", "eps")).alias("payout_ratio"),
        N.eps_acceleration(eps, "eps_prev", "eps_prev2").alias("eps_acceleration"),
        F.when((price != 0) & (shares != 0), price * shares).alias("market_cap"),
    )


def historical_features(at: DataFrame, facts: DataFrame, dividends: DataFrame, earnings: DataFrame,
                        lag_days: int = 60, first_quarter: str | None = "2000-01-01",
                        clock: str = "period", key: str = "ticker") -> DataFrame:
    """Features at every (ticker, snapshot) of ``at`` using only what was known by then.

    ``clock='period'`` assumes a report is public ``lag_days`` after the quarter (dividends anchor
    on that quarter); ``clock='filed'`` uses the filing day (dividends anchor on the snapshot).
    Earnings surprises use ``snapshot - lag_days`` on both.  The side tables come in as one row per
    ticker, so all three joins are plain equi-joins on the ticker and share its partitioning.
    """
    snap = F.col("snapshot")
    d = (at.join(asof.period_array(facts, key), key, "left")
         .join(asof.amounts_by_ticker(dividends, key), key, "left")
         .join(asof.reports_by_ticker(earnings, key), key, "left"))
    if clock == "period":
        d = d.withColumn("quarter", latest_available_quarter(snap, lag_days, first_quarter)).filter("quarter IS NOT NULL")
        visible, anchor = asof.ended_by(F.col("periods"), F.col("quarter")), F.col("quarter")
    else:
        visible, anchor = asof.filed_by(F.col("periods"), snap), snap
    d = (d.withColumn("_visible", visible)
         .withColumn("ttm_div", asof.paid_between(F.col("payments"), F.date_sub(anchor, 365), anchor))
         .withColumn("eps_surprise", asof.mean_surprise(F.col("reports"), F.date_sub(snap, lag_days))))
    kept = [c for c in d.columns if c not in ("periods", "payments", "reports")]
    d = d.select(*kept, *lagged_inputs(F.col("_visible")))
    if clock == "filed":
        implied = F.when(F.col("eps") != 0, N.ratio("ni", "eps"))
        d = d.withColumn("shares", F.coalesce("shares", F.when(implied > 0, implied)))
    return derive_features(d)


def ttm_facts(quarterly: DataFrame, flows: list[str], balances: list[str], anchor: str = "net_income",
              key: str = "ticker") -> DataFrame:
    """Trailing twelve months per ticker: flows over the last four quarters, all four needed; balances
    from the newest quarter; no row at all when the anchor flow has no full window."""
    newest = Window.partitionBy(key).orderBy(F.col("period_end").desc())
    d = quarterly.withColumn("_r", F.row_number().over(newest)).filter("_r <= 4")
    def full(c):
        return F.when(F.count(c) == 4, F.sum(c)).alias(c)
    out = d.groupBy(key).agg(F.max("period_end").alias("as_of"), *[full(c) for c in flows],
                             *[F.max_by(c, "period_end").alias(c) for c in balances])
    return out.filter(F.col(anchor).isNotNull())


#: input column <- trailing fact names, first known one wins
TTM_OVERLAY = {"ni": ["net_income"], "rev": ["revenue"], "gross_profit": ["gross_profit"],
               "total_assets": ["total_assets"], "eps": ["eps_diluted", "eps"], "fcf": ["fcf"],
               "equity": ["equity"], "total_debt": ["total_debt"], "curr_assets": ["current_assets"],
               "curr_liab": ["current_liabilities"], "shares": ["shares", "current_shares", "issued_shares"]}


def ttm_overlay(filed: DataFrame, ttm: DataFrame, key: str = "ticker") -> DataFrame:
    """Levels switch to the trailing figures where known; displaced as-filed values are parked."""
    present = set(ttm.columns)
    t = ttm.select(key, *[F.col(c).alias(f"t_{c}") for c in ttm.columns if c != key])
    d = filed.join(t, key, "left")
    new, parked = {}, {}
    for name, sources in TTM_OVERLAY.items():
        found = [F.col(f"t_{s}") for s in sources if s in present]
        if not found:
            continue
        value = F.coalesce(*found)
        new[name] = F.coalesce(value, F.col(name))
        if name in AS_FILED:
            parked[AS_FILED[name]] = F.when(value.isNotNull(), F.col(name))
    for twin in AS_FILED.values():
        parked.setdefault(twin, F.lit(None).cast("double"))
    return d.select(*[new.get(c, F.col(c)).alias(c) for c in filed.columns],
                    *[c.alias(n) for n, c in parked.items()])


def consistent_scale(ni: str = "ni", eps: str = "eps", shares: str = "shares", limit: float = 0.25) -> Column:
    """False when NI/EPS and the share count disagree by more than ``limit`` (all three positive)."""
    known = (F.col(ni) > 0) & (F.col(eps) > 0) & (F.col(shares) > 0)
    gap = F.abs(N.ratio(N.ratio(ni, eps), shares) - 1.0)
    return F.when(known, gap <= limit).otherwise(True)


def quarterly_or_annual_dividend(rows: DataFrame, key: str = "ticker") -> DataFrame:
    """Sum of the newest four quarterly payments when all are known, else the newest known annual one.

    ``rows``: ticker, kind ('quarterly' / 'annual'), paid_on, amount.
    """
    w = Window.partitionBy(key, "kind").orderBy(F.col("paid_on").desc())
    d = rows.withColumn("_r", F.row_number().over(w))
    q = (F.col("kind") == "quarterly") & (F.col("_r") <= 4)
    known_annual = (F.col("kind") == "annual") & F.col("amount").isNotNull()
    return d.groupBy(key).agg(
        F.coalesce(F.when(F.count(F.when(q, F.col("amount"))) == 4, F.sum(F.when(q, F.col("amount")))),
                   F.min_by(F.when(known_annual, F.col("amount")), F.when(known_annual, F.col("_r")))).alias("ttm_div"))


def live_features(quotes: DataFrame, technicals: DataFrame, annual_as_of: DataFrame, ttm: DataFrame,
                  ttm_div: DataFrame, surprise: DataFrame, key: str = "ticker") -> DataFrame:
    """Quote values overridden by statement growth and by trailing-then-annual levels.

    ``annual_as_of`` carries the LAGGED columns; ``ttm`` the trailing facts.
    """
    t = ttm.select(key, *[F.col(c).alias(f"t_{c}") for c in ttm.columns if c != key])
    d = (quotes.join(technicals, key, "left").join(annual_as_of, key, "left").join(t, key, "left")
         .join(ttm_div, key, "left").join(surprise, key, "left"))
    def level(fact: str, name: str) -> Column:
        return F.coalesce(F.col(f"t_{fact}"), F.col(name)) if f"t_{fact}" in d.columns else F.col(name)
    ni, ta, eq, rev = level("net_income", "ni"), level("total_assets", "total_assets"), level("equity", "equity"), level("revenue", "rev")
    debt, ca, cl = level("total_debt", "total_debt"), level("current_assets", "curr_assets"), level("current_liabilities", "curr_liab")
    price = F.coalesce(F.col("price"), F.col("q_current_price"), F.col("q_regular_price"))
    growth = F.coalesce(N.pct_change("ni", "ni_prev"), F.col("q_earnings_growth"))
    own_yield = F.when((F.col("ttm_div") > 0) & (price > 0), N.ratio("ttm_div", price))
    spare_fcf = F.col("q_operating_cashflow") - F.abs(F.col("q_capex"))
    tech = [c for c in technicals.columns if c not in (key, "price", "snapshot")]
    return d.select(
        key, *tech, price.alias("current_price"), F.col("q_market_cap").alias("market_cap"),
        F.col("q_trailing_pe").alias("trailing_pe"), F.col("q_price_to_book").alias("price_to_book"),
        N.peg("q_trailing_pe", growth).alias("peg_ratio"),
        F.coalesce(N.ratio_pos(ni, eq), F.col("q_return_on_equity")).alias("return_on_equity"),
        F.coalesce(N.ratio_pos(ni, ta), F.col("q_return_on_assets")).alias("return_on_assets"),
        F.coalesce(N.ratio_pos(ni, rev), F.col("q_profit_margin")).alias("profit_margin"),
        growth.alias("earnings_growth"), N.cagr_2y("ni", "ni_prev2").alias("earnings_cagr_2y"),
        F.coalesce(N.pct_change("rev", "rev_prev"), F.col("q_revenue_growth")).alias("revenue_growth"),
        F.when(F.col("total_assets_prev") > 0,
               N.ratio(F.col("total_assets") - F.col("total_assets_prev"), "total_assets_prev")).alias("asset_growth"),
        N.margin_improving("gross_profit", "rev", "gross_profit_prev", "rev_prev").alias("margin_improving"),
        N.roa_improving("ni", "total_assets", "ni_prev", "total_assets_prev").alias("roa_improving"),
        F.coalesce(N.ratio_pos(debt, eq) * 100.0, F.col("q_debt_to_equity")).alias("debt_to_equity"),
        F.coalesce(N.ratio_pos(ca, cl), F.col("q_current_ratio")).alias("current_ratio"),
        F.coalesce(F.col("t_fcf"), spare_fcf, F.col("q_free_cashflow")).alias("free_cashflow"),
        F.coalesce(own_yield, N.sanitize_yield("q_dividend_yield")).alias("dividend_yield"),
        F.col("q_payout_ratio").alias("payout_ratio"),
        F.coalesce(F.col("eps_surprise"), F.col("q_eps_surprise")).alias("eps_surprise"),
        N.eps_acceleration("eps", "eps_prev", "eps_prev2").alias("eps_acceleration"),
    )


def provider_ratio_features(d: DataFrame) -> DataFrame:
    """A provider that serves ratios: D/E in ratio form, free cash flow per share."""
    cap = F.coalesce(F.when(F.col("market_cap") != 0, F.col("market_cap")), F.col("mkt_cap"))
    shares = F.coalesce(F.when(F.col("shares_outstanding") > 0, F.col("shares_outstanding")),
                        N.ratio_pos(cap, "price"))
    return d.select(
        "ticker", F.col("price").alias("current_price"), cap.alias("market_cap"),
        F.col("pe").alias("trailing_pe"), F.col("pb").alias("price_to_book"), F.col("peg").alias("peg_ratio"),
        (F.col("debt_to_equity_ratio") * 100.0).alias("debt_to_equity"),
        shares.alias("shares"), F.when(shares > 0, F.col("fcf_per_share") * shares).alias("free_cashflow"))


def piotroski(cur: Column, prev: Column) -> Column:
    """Nine checks over two consecutive years as one struct; NULL unless every input is usable.

    ``cur`` and ``prev`` are structs of facts.
    """
    inputs = [cur[c] for c in ("net_income", "total_assets", "ocf", "total_debt", "current_assets",
                               "current_liabilities", "shares", "gross_profit", "revenue")]
    inputs += [prev[c] for c in ("net_income", "total_assets", "total_debt", "current_assets",
                                 "current_liabilities", "shares", "gross_profit", "revenue")]
    usable = inputs[0].isNotNull()
    for c in inputs[1:]:
        usable = usable & c.isNotNull()
    for s in (cur, prev):
        usable = usable & (s["total_assets"] > 0) & (s["current_liabilities"] > 0) & (s["revenue"] > 0)
    r = N.ratio
    checks = {
        "roa_positive": r(cur["net_income"], cur["total_assets"]) > 0,
        "ocf_positive": cur["ocf"] > 0,
        "roa_improving": r(cur["net_income"], cur["total_assets"]) > r(prev["net_income"], prev["total_assets"]),
        "accruals": cur["ocf"] > cur["net_income"],
        "leverage_decreasing": r(cur["total_debt"], cur["total_assets"]) < r(prev["total_debt"], prev["total_assets"]),
        "liquidity_improving": r(cur["current_assets"], cur["current_liabilities"]) > r(prev["current_assets"], prev["current_liabilities"]),
        "no_dilution": cur["shares"] <= prev["shares"],
        "margin_improving": r(cur["gross_profit"], cur["revenue"]) > r(prev["gross_profit"], prev["revenue"]),
        "turnover_improving": r(cur["revenue"], cur["total_assets"]) > r(prev["revenue"], prev["total_assets"]),
    }
    return F.when(usable, F.struct(N.true_count(*checks.values()).alias("score"),
                                   *[c.alias(n) for n, c in checks.items()]))


PIOTROSKI_CHECKS = ["roa_positive", "ocf_positive", "roa_improving", "accruals", "leverage_decreasing",
                    "liquidity_improving", "no_dilution", "margin_improving", "turnover_improving"]


def altman(cur: Column) -> Column:
    """Struct of z-score and zone (2.99 safe, 1.81 grey); NULL unless every input is usable."""
    ta, tl = cur["total_assets"], cur["total_liabilities"]
    names = ("current_assets", "current_liabilities", "retained_earnings", "ebit", "revenue", "equity")
    usable = (ta > 0) & (tl > 0)
    for c in names:
        usable = usable & cur[c].isNotNull()
    z = (N.ratio((cur["current_assets"] - cur["current_liabilities"]) * 1.2, ta)
         + N.ratio(cur["retained_earnings"] * 1.4, ta) + N.ratio(cur["ebit"] * 3.3, ta)
         + N.ratio(cur["equity"] * 0.6, tl) + N.ratio(cur["revenue"], ta))
    zone = F.when(z >= 2.99, "safe").when(z >= 1.81, "grey").otherwise("distress")
    return F.when(usable, F.struct(z.alias("z_score"), zone.alias("zone")))


def etf_features(quotes: DataFrame, technicals: DataFrame, key: str = "ticker") -> DataFrame:
    """Fund fields plus price features and the return-over-risk proxy."""
    d = quotes.join(technicals, key, "left")
    return d.withColumn("sharpe_proxy", N.sharpe_proxy("return_12m", "volatility_1y")).withColumn(
        "yield", N.sanitize_yield("fund_yield"))
