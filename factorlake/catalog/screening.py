"""Universe, filters, screening, holdings, portfolio review, risk signals."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import asof as A, filters as L, fundamentals as U, holdings as H, macro as MC, ranking as R, risk as K, scoring as S, technicals as T
from ..plans import advisor as AD, research as Q, screen as SC
from ..sources import driver_views as V
from . import sqlviews as SQ
from .evaluation import CFG, market, stocks
from .registry import query, rnd, rounded
from .sqlviews import compose, r

# ---- universe ----------------------------------------------------------------------------------


@query("universe_pools", "SRC-20 SET-1 JOIN-9 FLT-5 FLT-9", compose(
    """SELECT symbol, pool, ord, ticker FROM (SELECT UPPER(t) AS symbol, pool, ord, t AS ticker, ROW_NUMBER() OVER (PARTITION BY UPPER(t) ORDER BY pool, ord, t) AS k FROM (
 SELECT u.*, COALESCE(canonical, u.ticker) AS t FROM universe u LEFT JOIN aliases ON UPPER(alias) = UPPER(u.ticker) WHERE asset_class = 'stocks')) WHERE k = 1"""))
def universe_pools(spark, sf_dir):
    u = L.select_pools(V.universe(spark, sf_dir), "stocks", ["all"])
    d = L.distinct_pools(L.canonical_ticker(u, V.aliases(spark, sf_dir)))
    return d.filter(X.is_ticker("symbol")).select("symbol", F.col("pool").cast("int").alias("pool"), "ord", "ticker")


@query("currency_regions", "JOIN-10 FLT-5", compose(
    "SELECT asset_class, region, pool, COUNT(*) AS assets FROM universe WHERE region IN ('us', 'asia', 'consensus') GROUP BY ALL"))
def currency_regions(spark, sf_dir):
    """Pools reached by a USD and JPY filter."""
    d = L.select_pools(V.universe(spark, sf_dir), "all", L.region_codes(["USD", "JPY"]))
    return d.groupBy("asset_class", "region", F.col("pool").cast("int").alias("pool")).agg(F.count("*").alias("assets"))


@query("us_listings", "FLT-10", compose(
    f"""SELECT symbol, asset_type FROM (SELECT *, split_part(symbol, '.', 2) AS sfx FROM profiles) WHERE sfx NOT IN ({", ".join(f"'{s}'" for s in (*X.EUROPE_SUFFIXES, *X.ASIA_SUFFIXES))})"""))
def us_listings(spark, sf_dir):
    return L.us_only(V.profiles(spark, sf_dir)).select("symbol", "asset_type")


@query("listing_fields", "SCL-S3 SCL-S4 SCL-S5 FLT-10 JOIN-11 JOIN-21 FLT-4", compose(
    f"""SELECT symbol, CASE WHEN sfx IN ({", ".join(f"'{s}'" for s in X.EUROPE_SUFFIXES)}) THEN 'eu' WHEN sfx IN ({", ".join(f"'{s}'" for s in X.ASIA_SUFFIXES)}) THEN 'asia' ELSE 'us' END AS listing_region,
 base, sfx AS suffix, REPLACE(UPPER(TRIM(symbol)), '.', '-') AS normal, CASE sector {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.HOUSE_SECTOR.items())} ELSE sector END AS house_sector,
 CASE sfx {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in L.SUFFIX_VENUES.items())} END AS venue_a, CASE sfx {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in L.SUFFIX_VENUES.items())} END AS venue_b, asset_type
 FROM (SELECT *, split_part(symbol, '.', 1) AS base, split_part(symbol, '.', 2) AS sfx FROM profiles)"""))
def listing_fields(spark, sf_dir):
    p = V.profiles(spark, sf_dir)
    s = F.col("symbol")
    none = F.lit(None).cast("string")
    return p.select("symbol", X.infer_region(s).alias("listing_region"), X.split_base(s).alias("base"), X.split_suffix(s).alias("suffix"), X.norm_symbol(s).alias("normal"),
                    L.house_sector(F.col("sector")).alias("house_sector"), L.venue(s, none, 0).alias("venue_a"), L.venue(s, none, 1).alias("venue_b"),
                    L.asset_class(F.col("asset_type")).alias("asset_type"))


# ---- assets at their last session ---------------------------------------------------------------
_HS = "CASE p.sector " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.HOUSE_SECTOR.items()) + " ELSE p.sector END"
#: last-session features: statements known on the newest day of all, everything of a stock and a fund in one row
_NOW = {
    "lastday": "SELECT MAX(session) AS snapshot FROM trades",
    "now0": f"SELECT t.ticker, d.snapshot, t.session, t.close AS price, t.n AS bars, {SQ._carry}, macd_line, macd_histogram FROM tech t JOIN macd m ON m.ticker = t.ticker AND m.n = t.n JOIN lastday d ON d.snapshot >= t.session AND (t.next IS NULL OR d.snapshot < t.next)",
    "now_surprises": SQ.V["surprises"].replace("snaprows", "now0"),
    "now_in": SQ.V["inputs_classic"].replace("snaprows", "now0").replace("surprises", "now_surprises"),
    "now_feat": SQ.derived("now_in"),
    "assets": f"""SELECT f.* EXCLUDE (total_assets, market_cap), f.total_assets AS book_assets, p.* EXCLUDE (ticker, sector, total_assets), {_HS} AS sector, p.total_assets,
 CASE WHEN p.asset_type = 'ETF' THEN p.total_assets ELSE f.market_cap END AS market_cap, p.fund_yield AS yield,
 CASE WHEN volatility_1y > 0 THEN (return_12m - 0.045e0) / volatility_1y END AS sharpe_proxy FROM now_feat f JOIN profiles p ON p.ticker = f.ticker""",
}
_ETFQ = {"momentum": SQ.mix((SQ.lin("return_1m", .08, -.12), .15), (SQ.lin("return_3m", .20, -.25), .25), (SQ.lin("return_6m", .30, -.35), .30), (SQ.lin("return_12m", .50, -.40), .30)),
         "risk": SQ.mix((SQ.lin("volatility_1y", .10, .70), .50), (SQ.lin("beta_3y", .5, 2.5, 60), .50)),
         "cost": SQ.lin("expense_ratio", .03, 1.50, 60), "liquidity": SQ.lin("CASE WHEN total_assets > 0 THEN LOG10(total_assets) END", 12, 8)}
_ETFC = {"returns": SQ.mix((SQ.lin("three_year_return", .15, 0), .35), (SQ.lin("five_year_return", .12, 0), .40), (SQ.lin("return_12m", .20, -.10), .25)),
         "risk_adj": SQ.mix((SQ.lin("sharpe_proxy", 1.5, -.5), .70), (SQ.lin("volatility_1y", .10, .40), .30)),
         "size": SQ.lin("CASE WHEN total_assets > 0 THEN LOG10(total_assets) END", 11, 8),
         "cost_yield": SQ.mix((SQ.lin("expense_ratio", .03, .75, 60), .65), (SQ.lin("yield", .04, 0), .35))}
_cols = lambda d: ", ".join(f"{e} AS f_{n}" for n, e in d.items())
_NOW["etf_q"] = f"SELECT *, f_risk < 20 OR f_cost < 15 AS disqualified, CASE WHEN f_risk < 20 OR f_cost < 15 THEN LEAST({SQ.weighted(S.ETF_QUANT_WEIGHTS)}, 50e0) ELSE {SQ.weighted(S.ETF_QUANT_WEIGHTS)} END AS total FROM (SELECT *, {_cols(_ETFQ)} FROM assets WHERE asset_type = 'ETF')"
_NOW["etf_c"] = f"SELECT *, {SQ.weighted(S.ETF_WEIGHTS)} AS total FROM (SELECT *, {_cols(_ETFC)} FROM assets WHERE asset_type = 'ETF')"
_NOW["stock_q"] = SQ.quant_total("(SELECT * FROM assets WHERE asset_type = 'STOCK')")
_NOW["all_q"] = "SELECT ticker, symbol, asset_type, sector, region, currency, market_cap, total, session FROM stock_q UNION ALL SELECT ticker, symbol, asset_type, sector, region, currency, market_cap, total, session FROM etf_q"


def assets(spark, sf_dir):
    """Stocks and funds in one table, each described at its own last session."""
    m = market(spark, sf_dir)
    day = A.latest_end(m.sessions).select(F.array("latest").alias("dates"))
    f = U.historical_features(T.features_at(m.prices, day), m.annual, m.dividends, m.earnings, CFG.lag_days, None)
    f = f.withColumnRenamed("market_cap", "_cap").drop("total_assets", "_visible", "quarter")
    p = V.profiles(spark, sf_dir).withColumn("sector", L.house_sector(F.col("sector")))
    d = f.join(p, "ticker")
    fund = F.col("asset_type") == "ETF"
    d = d.withColumn("market_cap", F.when(fund, F.col("total_assets")).otherwise(F.col("_cap"))).withColumn("yield", F.col("fund_yield"))
    return T.with_sharpe_proxy(d).withColumn("ord", F.col("ticker")).drop("_cap")


@query("fund_features", "FUN-9 SCL-M11 SCL-M8 SCL-M10", compose(
    f"SELECT ticker, {r('return_3m')} AS return_3m, {r('return_6m')} AS return_6m, {r('volatility_1y')} AS volatility_1y, {r('sharpe_proxy')} AS sharpe_proxy, yield, expense_ratio FROM assets WHERE asset_type = 'ETF'", **_NOW))
def fund_features(spark, sf_dir):
    """Funds at their last session; the yield is a decimal already, so it passes unchanged."""
    d = assets(spark, sf_dir).filter("asset_type = 'ETF'")
    return d.select("ticker", *rounded(d, "return_3m", "return_6m", "volatility_1y", "sharpe_proxy"), "yield", "expense_ratio")


_EQ, _EC = [f"f_{n}" for n in S.ETF_QUANT_WEIGHTS], [f"f_{n}" for n in S.ETF_WEIGHTS]


@query("fund_quant_scores", "SCO-11 SCO-12", compose("SELECT ticker, disqualified, " + ", ".join(f"{r(c, 5)} AS {c}" for c in [*_EQ, "total"]) + " FROM etf_q", **_NOW))
def fund_quant_scores(spark, sf_dir):
    d = S.score_etf_quant(assets(spark, sf_dir).filter("asset_type = 'ETF'"))
    return d.select("ticker", "disqualified", *rounded(d, *_EQ, "total", digits=5))


@query("fund_classic_scores", "SCO-10 SCO-12", compose("SELECT ticker, " + ", ".join(f"{r(c, 5)} AS {c}" for c in [*_EC, "total"]) + " FROM etf_c", **_NOW))
def fund_classic_scores(spark, sf_dir):
    d = S.score_etf_classic(assets(spark, sf_dir).filter("asset_type = 'ETF'"))
    return d.select("ticker", *rounded(d, *_EC, "total", digits=5))


SCREEN = SC.ScreenConfig(top_n=10, currencies=["USD", "EUR"], min_cap=3_000_000.0)
_SCREENED = "currency IS NULL OR currency IN ('USD', 'EUR')"


@query("screen_top", "PIP-1 FLT-1 FLT-2 TOP-1 EXT-2 SCO-12", compose(
    f"SELECT ticker, symbol, asset_type, currency, {r('market_cap', 2)} AS market_cap, {r('total', 5)} AS total FROM all_q WHERE ({_SCREENED}) AND market_cap >= 3000000 ORDER BY all_q.total DESC, ticker LIMIT 10", **_NOW))
def screen_top(spark, sf_dir):
    d = SC.screen(assets(spark, sf_dir), SCREEN)
    return d.select("ticker", "symbol", "asset_type", "currency", rnd("market_cap", 2).alias("market_cap"), F.round("total", 5).alias("total"))


@query("screen_sector", "FLT-3 FLT-6 PIP-1", compose(
    f"SELECT ticker, sector, {r('total', 5)} AS total FROM all_q WHERE LOWER(sector) LIKE 'consumer%' AND ticker % 3 <> 1", **_NOW))
def screen_sector(spark, sf_dir):
    """Every asset of a sector prefix; rows flagged with an error (here a third of them) are never scored."""
    failed = F.when(F.col("ticker") % 3 == 1, F.array(F.lit("no quote"))).otherwise(F.array().cast("array<string>"))
    d = assets(spark, sf_dir).withColumn("errors", failed)
    d = SC.filtered(SC.scored_assets(d, SCREEN), SC.ScreenConfig(sector="CONSUMER", min_cap=0.0))
    return d.select("ticker", "sector", F.round("total", 5).alias("total"))


@query("report_table", "SNK-1 SCL-A1 SCL-S1 SCL-S2 WIN-14")
def report_table(spark, sf_dir):
    """Presentation rows of the best ten per asset type, with factor breakdown and reasons."""
    d = SC.scored_assets(assets(spark, sf_dir), SCREEN)
    ranked = R.top_n(d, ["asset_type"], 10)
    return SC.report_rows(ranked)


@query("report_page", "FLT-13 TOP-5", compose(
    f"SELECT symbol, sector, {r('score', 2)} AS score, {r('return_12m')} AS return_12m FROM (SELECT a.symbol, a.name, a.sector, a.return_12m, q.total AS score FROM all_q q JOIN assets a ON a.ticker = q.ticker) "
    "WHERE (LOWER(symbol) LIKE '%t1%' OR LOWER(name) LIKE '%t1%' OR LOWER(sector) LIKE '%t1%') AND score >= 40 AND return_12m * 100 >= -20", **_NOW))
def report_page(spark, sf_dir):
    d = SC.scored_assets(assets(spark, sf_dir), SCREEN).withColumn("score", F.col("total"))
    d = L.report_filter(d, text="T1", min_score=40, min_12m=-20)
    return d.orderBy(*L.report_order("return_12m", True)).select("symbol", "sector", F.round("score", 2).alias("score"), rnd("return_12m").alias("return_12m"))


@query("session_labels", "AGG-18", compose("SELECT COUNT(DISTINCT session) AS sessions, MIN(session) AS first_session, MAX(session) AS last_session FROM now0", **_NOW))
def session_labels(spark, sf_dir):
    m = market(spark, sf_dir)
    day = A.latest_end(m.sessions).select(F.array("latest").alias("dates"))
    d = SC.session_labels(T.features_at(m.prices, day))
    return d.select(F.size("sessions").cast("bigint").alias("sessions"), F.get("sessions", F.lit(0)).alias("first_session"), F.element_at("sessions", -1).alias("last_session"))


@query("early_cap_gate", "FLT-7 JOIN-16", compose(
    "SELECT ticker, COUNT(*) AS bars FROM px WHERE ticker IN (SELECT ticker FROM profiles WHERE total_assets IS NULL OR total_assets >= 50000000000) GROUP BY 1"))
def early_cap_gate(spark, sf_dir):
    """Only a known cap below the floor skips the price scan."""
    q = V.profiles(spark, sf_dir).select("ticker", F.col("total_assets").alias("market_cap"))
    return L.early_cap_gate(V.prices(spark, sf_dir), q, 50_000_000_000.0).groupBy("ticker").agg(F.count("*").alias("bars"))


@query("source_fallback", "JOIN-16", compose(
    "SELECT ticker, CASE WHEN ticker % 4 = 1 AND ticker % 6 <> 3 THEN 1 WHEN ticker % 4 = 1 THEN 0 ELSE 0 END AS source, ticker % 4 = 1 AND ticker % 6 = 3 AS failed FROM profiles"))
def source_fallback(spark, sf_dir):
    """The first source fails for every fourth asset, the second for some of those."""
    p = V.profiles(spark, sf_dir).select("ticker", "sector")
    fail = lambda cond: F.when(cond, F.array(F.lit("failed"))).otherwise(F.array().cast("array<string>"))
    a = p.withColumn("errors", fail(F.col("ticker") % 4 == 1))
    b = p.withColumn("errors", fail(F.col("ticker") % 6 == 3))
    d = L.source_fallback([a, b])
    return d.select("ticker", "source", (F.size("errors") > 0).alias("failed"))


@query("enrich_rows", "JOIN-15", compose(
    f"""SELECT a.ticker, {r("CASE WHEN swap THEN b.market_cap ELSE COALESCE(a.market_cap, b.market_cap) END", 2)} AS market_cap, {r("CASE WHEN swap THEN b.trailing_pe ELSE a.trailing_pe END")} AS trailing_pe,
 {r("CASE WHEN swap THEN b.eps_surprise ELSE COALESCE(a.eps_surprise, b.eps_surprise) END")} AS eps_surprise, swap AS replaced FROM (
 SELECT a.*, COALESCE((a.trailing_pe > 150 OR a.price_to_book > 60) AND ABS(a.market_cap / b.market_cap - 1) > 0.25, FALSE) AS swap FROM pa a LEFT JOIN pb b ON a.ticker = b.ticker) a LEFT JOIN pb b ON a.ticker = b.ticker""",
    last="SELECT * FROM quant_classic WHERE snapshot = (SELECT MAX(snapshot) FROM snaps)",
    pa="SELECT ticker, CASE WHEN ticker % 3 <> 0 THEN market_cap * 2 END AS market_cap, trailing_pe, price_to_book, CASE WHEN ticker % 4 <> 0 THEN eps_surprise END AS eps_surprise FROM last",
    pb="SELECT ticker, market_cap, trailing_pe, price_to_book, eps_surprise FROM last WHERE ticker % 10 <> 9"))
def enrich_rows(spark, sf_dir):
    from ..plans import evaluate as E
    m = market(spark, sf_dir)
    dates = E.dates_of(m, CFG).select(F.slice("dates", -1, 1).alias("dates"))
    f = E.snapshot_features(m, CFG, dates).join(stocks(spark, sf_dir), "ticker", "left_semi").select("ticker", "market_cap", "trailing_pe", "price_to_book", "eps_surprise")
    a = f.withColumn("market_cap", F.when(F.col("ticker") % 3 != 0, F.col("market_cap") * 2)).withColumn("eps_surprise", F.when(F.col("ticker") % 4 != 0, F.col("eps_surprise")))
    d = L.enrich(a, f.filter(F.col("ticker") % 10 != 9))
    return d.select("ticker", rnd("market_cap", 2).alias("market_cap"), rnd("trailing_pe").alias("trailing_pe"), rnd("eps_surprise").alias("eps_surprise"), "replaced")


# ---- holdings ----------------------------------------------------------------------------------
_AGG = {"agg": "SELECT CASE REPLACE(symbol, '.', '-') WHEN 'S-1' THEN 'S-0' ELSE REPLACE(symbol, '.', '-') END AS symbol, COUNT(*) AS manager_count, CAST(SUM(bps) AS BIGINT) AS total_weight FROM holdings GROUP BY 1"}


@query("holdings_consensus", "AGG-7 FLT-9 SCL-S5", compose("SELECT symbol, manager_count, total_weight FROM agg WHERE manager_count >= 2", **_AGG))
def holdings_consensus(spark, sf_dir):
    d = H.consensus(V.holdings(spark, sf_dir), 2, "bps", {"S-1": "S-0"})
    return d.orderBy(*H.consensus_order(d)).select("symbol", "manager_count", "total_weight")


@query("attach_holders", "JOIN-8", compose("SELECT p.ticker, manager_count AS superinvestor_count FROM profiles p LEFT JOIN agg ON agg.symbol = 'S-' || p.ticker", **_AGG))
def attach_holders(spark, sf_dir):
    counts = H.consensus(V.holdings(spark, sf_dir), 1, "bps", {"S-1": "S-0"})
    p = V.profiles(spark, sf_dir).select("ticker", F.concat(F.lit("s-"), F.col("ticker").cast("string")).alias("code"))
    return H.attach_holders(p, counts, "code").select("ticker", "superinvestor_count")


@query("universe_audit", "JOIN-18", compose(
    """SELECT symbol, manager_count, status, CASE WHEN status = 'excluded' THEN reason END AS reason FROM (SELECT *, CASE WHEN cur AND manager_count IS NULL THEN 'dropped' WHEN cur AND manager_count < 40 THEN 'thin'
 WHEN NOT cur AND manager_count >= 40 AND reason IS NOT NULL THEN 'excluded' WHEN NOT cur AND manager_count >= 40 THEN 'missing' END AS status FROM (
 SELECT COALESCE(c.symbol, a.symbol) AS symbol, manager_count, c.symbol IS NOT NULL AS cur, CASE WHEN asset_type = 'ETF' THEN 'fund' WHEN cap IS NULL THEN 'no market cap' WHEN cap < 30000 THEN 'below floor' END AS reason
 FROM (SELECT 'S-' || ticker AS symbol FROM profiles WHERE ticker % 3 = 0 UNION ALL SELECT 'S-' || (ticker + 1000000000) FROM profiles WHERE ticker % 20 = 0) c FULL JOIN agg a ON a.symbol = c.symbol
 LEFT JOIN (SELECT 'S-' || ticker AS symbol, asset_type, CASE WHEN ticker % 7 <> 0 THEN ticker * 1000 END AS cap FROM profiles) q ON q.symbol = COALESCE(c.symbol, a.symbol))) WHERE status IS NOT NULL""", **_AGG))
def universe_audit(spark, sf_dir):
    p = V.profiles(spark, sf_dir)
    code = lambda k: F.concat(F.lit("S-"), k.cast("string"))
    curated = p.filter(F.col("ticker") % 3 == 0).select(code(F.col("ticker")).alias("symbol")).unionByName(
        p.filter(F.col("ticker") % 20 == 0).select(code(F.col("ticker") + 1000000000).alias("symbol")))
    quotes = p.select(code(F.col("ticker")).alias("symbol"), "asset_type", F.when(F.col("ticker") % 7 != 0, F.col("ticker") * 1000).alias("market_cap"))
    return H.audit_universe(curated, H.consensus(V.holdings(spark, sf_dir), 1, "bps", {"S-1": "S-0"}), quotes, 40, 30_000.0)


@query("report_quarter", "AGG-16", compose(
    "SELECT period, managers, ROW_NUMBER() OVER (ORDER BY managers DESC, period) AS rank FROM (SELECT 'Q' || (CASE WHEN manager % 9 = 0 THEN 2 WHEN manager % 9 = 4 THEN 1 ELSE 3 END) || ' 2001' AS period, COUNT(DISTINCT manager) AS managers FROM holdings GROUP BY 1)"))
def report_quarter(spark, sf_dir):
    m = V.holdings(spark, sf_dir).select("manager").distinct()
    q = F.when(F.col("manager") % 9 == 0, 2).when(F.col("manager") % 9 == 4, 1).otherwise(3)
    return H.report_quarter(m.select(F.concat(F.lit("Q"), q.cast("string"), F.lit(" 2001")).alias("period")))


# ---- portfolio and advisor ---------------------------------------------------------------------

@query("portfolio_review", "AGG-12", compose(
    """SELECT portfolio, CAST(SUM(n) AS BIGINT) AS count, CAST(SUM(weak) AS BIGINT) AS weak, CAST(SUM(moderate) AS BIGINT) AS moderate, CAST(SUM(strong) AS BIGINT) AS strong, round_even(SUM(score) / SUM(n), 1) AS avg_score, SUM(n) < 5 AS few_holdings, COUNT(*) AS sectors FROM (
 SELECT ticker % 6 AS portfolio, COALESCE(sector, 'Unknown') AS sector, COUNT(*) AS n, SUM(total) AS score, COUNT(CASE WHEN total < 40 THEN 1 END) AS weak, COUNT(CASE WHEN total >= 40 AND total < 60 THEN 1 END) AS moderate, COUNT(CASE WHEN total >= 60 THEN 1 END) AS strong
 FROM all_q GROUP BY 1, 2) GROUP BY 1""", **_NOW))
def portfolio_review(spark, sf_dir):
    d = AD.portfolio_review(SC.scored_assets(assets(spark, sf_dir), SCREEN).withColumn("portfolio", F.col("ticker") % 6), ["portfolio"])
    return d.select("portfolio", "count", "weak", "moderate", "strong", "avg_score", "few_holdings", F.col("sectors").cast("bigint").alias("sectors"))


def _tilt(p: str) -> str:
    inlist = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
    up, down = "LEAST(100e0, total + 5)", "GREATEST(0e0, total - 3)"
    if p == "conservative":
        return f"CASE WHEN COALESCE(sector, '') IN {inlist(S.DEFENSIVE)} THEN {up} WHEN sector IN {inlist(S.GROWTH)} THEN {down} WHEN COALESCE(sector, '') IN ('', 'Unknown') THEN LEAST(total, 50e0) ELSE total END"
    return f"CASE WHEN sector IN {inlist(S.GROWTH)} THEN {up} WHEN sector IN {inlist(S.DEFENSIVE)} THEN {down} ELSE total END"


@query("advisor_candidates", "TOP-3 JOIN-12 SCO-14", compose(
    f"SELECT symbol, sector, {r('tilted', 5)} AS total FROM (SELECT *, {_tilt('conservative')} AS tilted FROM (SELECT * FROM all_q ORDER BY total DESC, symbol LIMIT 25) WHERE ticker % 4 <> 0) ORDER BY tilted DESC, symbol LIMIT 10", **_NOW))
def advisor_candidates(spark, sf_dir):
    """Conservative candidates next to a portfolio of every fourth asset (15 names oversampled)."""
    d = SC.scored_assets(assets(spark, sf_dir), SCREEN)
    held = V.profiles(spark, sf_dir).filter(F.col("ticker") % 4 == 0).select(F.lower("symbol").alias("symbol"))
    return AD.candidates(d, held, 15, 10, "conservative").select("symbol", "sector", F.round("total", 5).alias("total"))


@query("advisor_by_region", "PIP-12 TOP-3 JOIN-12 SCO-14", compose(
    f"SELECT region, asset_type, symbol, {r('tilted', 5)} AS total FROM (SELECT *, {_tilt('aggressive')} AS tilted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region, asset_type ORDER BY total DESC, symbol) AS k FROM all_q) WHERE k <= 5 AND ticker % 4 <> 0)", **_NOW))
def advisor_by_region(spark, sf_dir):
    d = SC.scored_assets(assets(spark, sf_dir), SCREEN)
    held = V.profiles(spark, sf_dir).filter(F.col("ticker") % 4 == 0).select("symbol")
    return AD.comprehensive(d, held, ["region", "asset_type"], 5, "aggressive").select("region", "asset_type", "symbol", F.round("total", 5).alias("total"))


@query("missing_sectors", "SET-2", compose(
    "SELECT sector FROM (SELECT UNNEST([" + ", ".join(f"'{s}'" for s in MC.ALL_SECTORS) + f"]) AS sector) WHERE sector NOT IN (SELECT {_HS} FROM profiles p WHERE ticker % 9 = 1)"))
def missing_sectors(spark, sf_dir):
    held = V.profiles(spark, sf_dir).filter(F.col("ticker") % 9 == 1).select(L.house_sector(F.col("sector")).alias("sector"))
    return L.missing_sectors(held, MC.ALL_SECTORS)


# ---- risk signals ------------------------------------------------------------------------------
_CS = {"hist": "SELECT ticker, party, MAX_BY(share, period_end) AS latest, CASE WHEN COUNT(*) > 1 THEN MIN_BY(share, period_end) END AS earliest FROM customer_shares GROUP BY 1, 2",
       "top": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY latest DESC, party DESC) AS k FROM hist) WHERE k = 1"}


@query("customer_concentration", "RSK-2 WIN-26 TOP-7", compose(
    """SELECT ticker, CASE WHEN latest >= 0.15e0 THEN 'medium' ELSE 'info' END AS severity, 'Key-customer concentration' AS label, party || ' at ' || printf('%.0f%%', latest * 100e0) || ' of revenue' ||
 CASE WHEN ABS(latest - earliest) >= 0.02e0 THEN ' (' || printf('%.0f%%', earliest * 100e0) || ' → ' || printf('%.0f%%', latest * 100e0) || ' over the disclosed history)' ELSE '' END AS detail FROM top WHERE latest >= 0.08e0""", **_CS))
def customer_concentration(spark, sf_dir):
    shares = V.customer_shares(spark, sf_dir).select("ticker", F.lit("customer").alias("risk"), "party", F.col("period_end").alias("period"), "share")
    return K.concentration_signals(shares, alert=0.15, watch=0.08).select("ticker", "severity", "label", "detail")


def _newest(d, period: str):
    """The rows of each filer's newest period."""
    return d.withColumn("_newest", F.max(period).over(Window.partitionBy("ticker"))).filter(F.col(period) == F.col("_newest")).drop("_newest")


@query("geography_concentration", "RSK-9 TOP-7", compose(
    "SELECT c.ticker, printf('%.0f%%', value * 100e0 / total) || ' of revenue from ' || party AS detail FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY value DESC, party DESC) AS k FROM customer_shares c WHERE period_end = (SELECT MAX(period_end) FROM customer_shares m WHERE m.ticker = c.ticker)) c "
    "JOIN annual a ON a.ticker = c.ticker AND a.period_end = c.period_end WHERE k = 1 AND CAST(value AS DOUBLE) / total >= 0.10e0 AND total / 100e0 / revenue BETWEEN 0.90e0 AND 1.10e0"))
def geography_concentration(spark, sf_dir):
    d = _newest(V.customer_shares(spark, sf_dir), "period_end")
    leaves = d.select("ticker", "party", (F.col("value") / 100.0).alias("value"))
    revenue = V.annual(spark, sf_dir).groupBy("ticker").agg(F.max_by("revenue", "period_end").alias("revenue"))
    return K.geography_signals(leaves, revenue, watch=0.10).select("ticker", "detail")


@query("product_concentration", "RSK-10 RSK-11 TOP-7", compose(
    """SELECT ticker, 'Product revenue concentration' AS label, printf('%.0f%%', value * 100e0 / total) || ' of revenue from ' || product AS detail FROM (SELECT *, SUM(value) OVER (PARTITION BY ticker) AS total, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY value DESC, product DESC) AS k
 FROM product_sales c WHERE fiscal_year = (SELECT MAX(fiscal_year) FROM product_sales m WHERE m.ticker = c.ticker)) WHERE k = 1 AND CAST(value AS DOUBLE) / CAST(total AS DOUBLE) >= 0.25e0
 UNION ALL SELECT ticker, 'Segment revenue concentration', printf('%.0f%%', value * 100e0 / total) || ' of revenue from the ' || product || ' segment' FROM (SELECT *, SUM(value) OVER (PARTITION BY ticker) AS total, COUNT(*) OVER (PARTITION BY ticker) AS c,
 ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY value DESC, product DESC) AS k FROM product_sales c WHERE fiscal_year = (SELECT MAX(fiscal_year) FROM product_sales m WHERE m.ticker = c.ticker)) WHERE k = 1 AND c >= 2 AND CAST(value AS DOUBLE) / CAST(total AS DOUBLE) >= 0.25e0"""))
def product_concentration(spark, sf_dir):
    p = _newest(V.product_sales(spark, sf_dir), "fiscal_year")
    newest = lambda name: p.select("ticker", F.col("product").alias(name), F.col("value").cast("double").alias("value"))
    revenue = p.groupBy("ticker").agg(F.sum("value").cast("double").alias("revenue"))
    a = K.product_signals(newest("product"), revenue, watch=0.25)
    return a.unionByName(K.segment_signals(newest("segment"), watch=0.25)).select("ticker", "label", "detail")


@query("local_risk_signals", "RSK-1 TOP-4 JOIN-25", compose(
    f"""SELECT ticker, severity, label FROM (SELECT x.ticker, UNNEST([
 CASE WHEN z < 1.81e0 THEN {{'severity': 'high', 'label': 'Altman Z in distress zone'}} END, CASE WHEN z >= 1.81e0 AND z < 2.99e0 THEN {{'severity': 'medium', 'label': 'Altman Z in grey zone'}} END,
 CASE WHEN profit_margin < 0 THEN {{'severity': 'medium', 'label': 'Loss-making'}} END, CASE WHEN free_cashflow < 0 THEN {{'severity': 'medium', 'label': 'Negative free cash flow'}} END,
 CASE WHEN debt_to_equity > 200 THEN {{'severity': 'medium', 'label': 'High leverage'}} END, CASE WHEN payout_ratio > 1 THEN {{'severity': 'medium', 'label': 'Dividend not covered by earnings'}} END,
 CASE WHEN payout_ratio > 0.85e0 AND payout_ratio <= 1 THEN {{'severity': 'info', 'label': 'High payout ratio'}} END, CASE WHEN NOT pio_accruals THEN {{'severity': 'medium', 'label': 'Earnings quality (accruals)'}} END,
 CASE WHEN NOT pio_margin_improving AND NOT pio_roa_improving THEN {{'severity': 'medium', 'label': 'Deteriorating fundamentals'}} END, CASE WHEN NOT pio_no_dilution THEN {{'severity': 'info', 'label': 'Share dilution'}} END,
 CASE WHEN NOT pio_leverage_decreasing THEN {{'severity': 'info', 'label': 'Rising leverage'}} END], recursive := TRUE) FROM (
 SELECT q.*, h.altman_z AS z, h.* EXCLUDE (ticker, snapshot) FROM quant_classic q LEFT JOIN health h ON h.ticker = q.ticker AND h.snapshot = q.snapshot WHERE q.snapshot = (SELECT MAX(snapshot) FROM snaps)) x) WHERE label IS NOT NULL""",
    **__import__("factorlake.catalog.research", fromlist=["_LOCAL"])._LOCAL))
def local_risk_signals(spark, sf_dir):
    from ..plans import evaluate as E
    m = market(spark, sf_dir)
    dates = E.dates_of(m, CFG).select(F.slice("dates", -1, 1).alias("dates"))
    f = Q.with_health(E.snapshot_features(m, CFG, dates).join(stocks(spark, sf_dir), "ticker", "left_semi"))
    return K.ordered(K.local_signals(f)).select("ticker", "severity", "label")


_PROVIDER = "SELECT ticker, ticker / 10e0 AS z, CASE WHEN ticker % 2 = 0 THEN 'safe' ELSE 'unrated' END AS zone FROM profiles"


@query("deep_dive", "JOIN-25 FUN-11 FUN-12", compose(
    f"SELECT q.ticker, {r('q.total', 5)} AS total, h.piotroski, {r('COALESCE(h.altman_z, x.z)')} AS altman_z, CASE WHEN h.altman_z IS NULL THEN x.zone WHEN h.altman_z >= 2.99e0 THEN 'safe' WHEN h.altman_z >= 1.81e0 THEN 'grey' ELSE 'distress' END AS altman_zone "
    "FROM quant_classic q LEFT JOIN health h ON h.ticker = q.ticker AND h.snapshot = q.snapshot LEFT JOIN (SELECT * FROM prov WHERE zone = 'safe') x ON x.ticker = q.ticker WHERE q.snapshot = (SELECT MAX(snapshot) FROM snaps)",
    prov=_PROVIDER, **__import__("factorlake.catalog.research", fromlist=["_LOCAL"])._LOCAL))
def deep_dive(spark, sf_dir):
    """Diagnostics at the last snapshot; the provider's figure fills unknown scores where its zone is valid."""
    from ..plans import deep_dive as DD, evaluate as E
    m = market(spark, sf_dir)
    dates = E.dates_of(m, CFG).select(F.slice("dates", -1, 1).alias("dates"))
    f = Q.with_health(E.snapshot_features(m, CFG, dates).join(stocks(spark, sf_dir), "ticker", "left_semi"))
    provider = V.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ticker"), (F.col("s_suppkey") / 10.0).alias("z_score"), F.when(F.col("s_suppkey") % 2 == 0, "safe").otherwise("unrated").alias("zone"))
    d = DD.deep_dive(E.scored(f, CFG), provider)
    return d.select("ticker", F.round("total", 5).alias("total"), F.col("pio.score").alias("piotroski"), rnd("alt.z_score").alias("altman_z"), F.col("alt.zone").alias("altman_zone"))
