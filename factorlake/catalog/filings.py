"""Statements, filings, payload readers, live features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..operators import asof as A, fundamentals as U, macro as MC, risk as K, statements as ST, technicals as T
from ..sources import driver_views as V, readers as RD, sinks as SK
from . import sqlviews as SQ
from .registry import query, rnd, rounded
from .screening import _NOW
from .sqlviews import compose, r

# ---- filing facts --------------------------------------------------------------------------------


def companyfacts(spark, sf_dir):
    """Filer payloads in the public XBRL layout as JSON text: own figures, comparatives and noise rows."""
    a = V.annual(spark, sf_dir)
    k = F.col("ticker")
    values = {
        "NetIncomeLoss": F.col("net_income"), "Revenues": F.when(k % 2 == 0, F.col("revenue")), "SalesRevenueNet": F.when(k % 2 == 1, F.col("revenue")),
        "EarningsPerShareBasic": F.col("eps"), "GrossProfit": F.when(k % 3 == 0, F.col("gross_profit")), "CostOfRevenue": F.col("revenue") - F.col("gross_profit"),
        "Assets": F.col("total_assets"), "StockholdersEquity": F.col("equity"), "LongTermDebt": F.when(k % 4 == 0, F.col("total_debt")),
        "LongTermDebtNoncurrent": F.when(k % 4 != 0, F.col("total_debt") * 0.75), "LongTermDebtCurrent": F.when(k % 4 == 1, F.col("total_debt") * 0.25),
        "CommercialPaper": F.when(k % 5 == 0, F.lit(1000.0)), "NetCashProvidedByUsedInOperatingActivities": F.col("ocf"),
        "PaymentsToAcquirePropertyPlantAndEquipment": F.when(k % 6 != 0, F.col("capex")),
    }
    items = F.array(*[F.struct(F.lit(n).alias("concept"), v.alias("val")) for n, v in values.items()])
    d = a.select("ticker", "period_end", "date_filed", F.explode(items).alias("i")).filter("i.val IS NOT NULL")
    # own filing, the same figure as next year's comparative, and a quarterly row that must be ignored
    versions = F.array(F.struct(F.col("date_filed").alias("filed"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp")),
                       F.struct(F.date_add("date_filed", 365).alias("filed"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp")),
                       F.struct(F.date_sub("date_filed", 90).alias("filed"), F.lit("10-Q").alias("form"), F.lit("Q3").alias("fp")))
    d = d.select("ticker", "i.concept", F.explode(versions).alias("v"), F.col("period_end").cast("string").alias("end"), F.col("i.val").alias("val"))
    row = F.struct("end", F.col("v.filed").cast("string").alias("filed"), "val", F.col("v.form").alias("form"), F.col("v.fp").alias("fp"))
    per = d.groupBy("ticker", "concept").agg(F.collect_list(row).alias("rows"))  # tens of rows per filer and concept
    node = F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units"))
    whole = per.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("concept", node))).alias("m"))
    return whole.select(F.col("ticker").alias("cik"), F.to_json(F.create_map(F.lit("us-gaap"), F.col("m"))).alias("facts"))


_FP = ["netIncome", "revenue", "eps", "grossProfit", "assets", "stockholdersEquity", "totalDebt", "freeCashFlow"]


@query("filing_periods", "SRC-8 FUN-1 FUN-2 FUN-3 WIN-28", compose(
    f"""SELECT ticker AS cik, period_end, date_filed, {r('net_income', 2)} AS "netIncome", {r('revenue', 2)} AS revenue, {r('eps', 4)} AS eps, {r('gross_profit', 2)} AS "grossProfit", {r('total_assets', 2)} AS assets, {r('equity', 2)} AS "stockholdersEquity",
 {r("CASE WHEN ticker % 4 = 0 OR ticker % 4 = 1 THEN total_debt ELSE total_debt * 0.75e0 END + CASE WHEN ticker % 5 = 0 THEN 1000 ELSE 0 END", 1)} AS "totalDebt", {r("CASE WHEN ticker % 6 <> 0 THEN ocf - capex END", 2)} AS "freeCashFlow" FROM annual"""))
def filing_periods(spark, sf_dir):
    raw = companyfacts(spark, sf_dir).withColumn("facts", F.from_json("facts", RD.COMPANYFACTS))
    d = ST.filed_periods(RD.flatten_companyfacts(raw))
    digits = {"eps": 4, "totalDebt": 1}
    return d.select("cik", F.col("end").alias("period_end"), F.col("filed").alias("date_filed"), *[F.round(c, digits.get(c, 2)).alias(c) for c in _FP])


@query("pit_periods", "SRC-7 SNK-5", compose("SELECT ticker, COUNT(*) AS periods, MAX(date_filed) AS last_filed, FALSE AS stitched FROM (SELECT CAST(ticker AS VARCHAR) AS ticker, date_filed FROM annual WHERE ticker % 9 <> 4 OR year(period_end) <> 1998) GROUP BY 1"))
def pit_periods(spark, sf_dir):
    """Filing rows as landed JSON; one year of some filers carries a broken date and drops out."""
    a = V.annual(spark, sf_dir)
    broken = (F.col("ticker") % 9 == 4) & (F.year("period_end") == 1998)
    row = F.struct(F.col("ticker").cast("string").alias("ticker"), F.lit("income").alias("statement"), F.concat(F.col("period_end").cast("string"), F.lit("T00:00:00")).alias("period"),
                   F.year("period_end").cast("string").alias("fiscalYear"), F.lit("FY").alias("fiscalPeriod"), F.when(broken, "n/a").otherwise(F.col("date_filed").cast("string")).alias("dateFiled"),
                   F.create_map(F.lit("netIncome"), F.col("net_income")).alias("facts"))
    raw = a.select(F.from_json(F.to_json(row), RD.PIT_SCHEMA).alias("r")).select("r.*")
    return SK.inventory(RD.parse_periods(raw))


@query("statement_merge", "JOIN-24 SRC-6", compose(
    f"SELECT ticker, period_end, {r('net_income', 2)} AS net_income, {r('revenue', 2)} AS revenue, {r('CASE WHEN ticker % 2 = 0 THEN equity + 1 ELSE equity END', 2)} AS equity, {r('fcf', 2)} AS fcf FROM annual"))
def statement_merge(spark, sf_dir):
    """Equity is listed twice for even filers: the earlier statement in the order supplies it."""
    a = V.annual(spark, sf_dir)
    labels = {"net_income": "net_income", "revenue": "revenue", "equity": "equity", "fcf": "fcf"}
    home = {"net_income": "income", "revenue": "income", "equity": "balance", "fcf": "cash"}
    table = F.create_map(*[F.lit(x) for kv in home.items() for x in kv])
    facts = ST.long_facts(a, labels, ["ticker", "period_end"]).withColumn("statement", table[F.col("fact")])
    twice = facts.filter((F.col("fact") == "equity") & (F.col("ticker") % 2 == 0)).withColumn("statement", F.lit("income")).withColumn("value", F.col("value") + 1)
    d = ST.combine_statements(facts.unionByName(twice), ["income", "balance", "cash"], list(labels))
    return d.select("ticker", "period_end", *rounded(d, *labels, digits=2))


@query("entity_stitching", "JOIN-22 SCL-S7", compose(
    """SELECT ticker, own, own_n, cik, n AS periods FROM (SELECT a.ticker, a.cik AS own, a.n AS own_n, c.cik, c.n, ROW_NUMBER() OVER (PARTITION BY a.cik ORDER BY c.n DESC, c.cik) AS k FROM ents a JOIN ents c
 ON c.cik <> a.cik AND c.n > a.n AND c.kind = 'stock' AND (starts_with(c.norm, a.norm) OR starts_with(c.norm, a.first) OR starts_with(c.norm, 'group')) AND date_diff('day', c.newest, DATE '2002-06-30') <= 550 WHERE a.ticker IS NOT NULL AND a.n < 3) WHERE k = 1""",
    ents="""SELECT s_suppkey AS cik, CASE WHEN s_suppkey % 10 = 3 THEN 'T' || s_suppkey END AS ticker, LOWER('Group' || (s_suppkey % 20) || CASE WHEN s_suppkey % 10 = 3 THEN 'Holdings' ELSE 'Corp' END) AS norm, LOWER('Group' || (s_suppkey % 20)) AS first,
 CASE WHEN s_suppkey % 7 = 2 THEN 'fund' ELSE 'stock' END AS kind, COALESCE(n, 0) AS n, newest FROM supplier LEFT JOIN (SELECT ticker AS t, COUNT(*) AS n, MAX(period_end) AS newest FROM annual
 WHERE (ticker % 10 <> 3 OR year(period_end) >= 2000) AND (ticker % 4 <> 1 OR year(period_end) < 2000) GROUP BY 1) ON t = s_suppkey"""))
def entity_stitching(spark, sf_dir):
    """Renamed holding companies with two periods look for a live predecessor with a longer series."""
    k = F.col("ticker")
    y = F.year("period_end")
    periods = V.annual_cents(spark, sf_dir).filter(((k % 10 != 3) | (y >= 2000)) & ((k % 4 != 1) | (y < 2000))).select(k.alias("cik"), "period_end")
    s = F.col("s_suppkey")
    entities = V.read(spark, sf_dir, "supplier").select(
        s.alias("cik"), F.when(s % 10 == 3, F.concat(F.lit("T"), s.cast("string"))).alias("ticker"),
        F.concat(F.lit("Group"), (s % 20).cast("string"), F.when(s % 10 == 3, " Holdings").otherwise(" Corp")).alias("name"), F.when(s % 7 == 2, "fund").otherwise("stock").alias("kind"))
    return ST.stitch_entities(periods, entities, F.lit("2002-06-30").cast("date"))


# ---- trailing figures and live features ------------------------------------------------------------
_FLOWS, _BALANCES = ["revenue", "net_income", "gross_profit", "eps", "ebit", "ocf", "fcf"], ["total_assets", "equity", "current_assets", "current_liabilities", "total_debt", "shares"]
_TTM = {"ttm": "SELECT ticker, MAX(period_end) AS as_of, " + ", ".join(f"CASE WHEN COUNT({c}) = 4 THEN SUM({c}) END AS {c}" for c in _FLOWS) + ", " + ", ".join(f"MAX_BY({c}, period_end) AS {c}" for c in _BALANCES)
        + " FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS k FROM quarterly) WHERE k <= 4 GROUP BY 1"}


@query("ttm_facts", "AGG-1", compose("SELECT ticker, as_of, " + ", ".join(f"{r(c, 2)} AS {c}" for c in _FLOWS + _BALANCES) + " FROM ttm", **_TTM))
def ttm_facts(spark, sf_dir):
    d = U.ttm_facts(V.quarterly(spark, sf_dir), _FLOWS, _BALANCES)
    return d.select("ticker", "as_of", *rounded(d, *_FLOWS, *_BALANCES, digits=2))


def _day(spark, sf_dir):
    return A.latest_end(V.last_sessions(spark, sf_dir)).select(F.array("latest").alias("dates"))


_LIVE = ["trailing_pe", "price_to_book", "return_on_equity", "return_on_assets", "profit_margin", "earnings_growth", "revenue_growth", "asset_growth", "debt_to_equity", "current_ratio"]
_LT = {**_NOW, **_TTM,
       "nowf_in": SQ.V["inputs_filed0"].replace("snaprows", "now0").replace("surprises", "now_surprises"),
       "over": """SELECT f.* EXCLUDE (ni, rev, gross_profit, total_assets, eps, fcf, equity, total_debt, curr_assets, curr_liab, shares), f.ni AS ni_a, f.rev AS rev_a, f.gross_profit AS gp_a, f.total_assets AS ta_a, f.eps AS eps_a,
 COALESCE(t.net_income, f.ni) AS ni, COALESCE(t.revenue, f.rev) AS rev, COALESCE(t.gross_profit, f.gross_profit) AS gross_profit, COALESCE(t.total_assets, f.total_assets) AS total_assets, COALESCE(t.eps, f.eps) AS eps, COALESCE(t.fcf, f.fcf) AS fcf,
 COALESCE(t.equity, f.equity) AS equity, COALESCE(t.total_debt, f.total_debt) AS total_debt, COALESCE(t.current_assets, f.curr_assets) AS curr_assets, COALESCE(t.current_liabilities, f.curr_liab) AS curr_liab, COALESCE(t.shares, f.shares) AS shares
 FROM nowf_in f LEFT JOIN ttm t ON t.ticker = f.ticker""",
       "live": SQ.derived("over", "ni_a", "rev_a", "eps_a", "gp_a", "ta_a")}


@query("filed_live_features", "FUN-8 SCL-A4 FLT-14", compose(
    "SELECT ticker, " + ", ".join(f"{r(c, 5)} AS {c}" for c in _LIVE) + ", NOT (ni > 0 AND eps > 0 AND shares > 0 AND ABS((ni / eps) / shares - 1) > 0.25) AS consistent FROM live", **_LT))
def filed_live_features(spark, sf_dir):
    """As-filed years for the comparisons, trailing figures for the levels, scale check as a flag."""
    day = _day(spark, sf_dir)
    f = U.historical_features(T.features_at(V.prices(spark, sf_dir), day), V.annual(spark, sf_dir), V.dividends(spark, sf_dir), V.earnings(spark, sf_dir), clock="filed")
    base = f.select("ticker", "price", "ttm_div", *U.LAGGED)
    d = U.derive_features(U.ttm_overlay(base, U.ttm_facts(V.quarterly(spark, sf_dir), _FLOWS, _BALANCES)))
    return d.select("ticker", *rounded(d, *_LIVE, digits=5), U.consistent_scale().alias("consistent"))


_QSQL = """SELECT p.ticker, price, f.* EXCLUDE (ticker, price), CASE WHEN p.ticker % 3 <> 0 THEN p.ticker % 40 + 5e0 END AS q_pe, (p.ticker % 50) / 100e0 AS q_growth, CASE WHEN p.ticker % 4 = 0 THEN 0.2e0 END AS q_roe, 3.5e0 AS q_yield,
 p.ticker * 10e0 AS q_ocf, -(p.ticker * 4e0) AS q_capex, p.ticker % 2 = 0 AS has_ttm FROM profiles p JOIN now_in f ON f.ticker = p.ticker"""


@query("live_features", "FUN-7 SRC-1", compose(
    f"""SELECT q.ticker, {r("CASE WHEN q_pe > 0 AND g > 0 AND g <= 1 THEN q_pe / (g * 100e0) END", 5)} AS peg_ratio, {r("g", 5)} AS earnings_growth, {r("COALESCE(" + SQ.pos("nl", "el") + ", q_roe)", 5)} AS return_on_equity,
 {r("CASE WHEN has_ttm THEN COALESCE(tf, q_ocf - ABS(q_capex)) ELSE q_ocf - ABS(q_capex) END", 2)} AS free_cashflow, {r("COALESCE(CASE WHEN ttm_div > 0 THEN ttm_div / price END, 0.035e0)", 5)} AS dividend_yield
 FROM (SELECT q.*, COALESCE({SQ.pct("ni", "ni_prev")}, q_growth) AS g, CASE WHEN has_ttm THEN COALESCE(t.net_income, ni) ELSE ni END AS nl, CASE WHEN has_ttm THEN COALESCE(t.equity, q.equity) ELSE q.equity END AS el, t.fcf AS tf FROM qlive q LEFT JOIN ttm t ON t.ticker = q.ticker) q""",
    **_LT, qlive=_QSQL))
def live_features(spark, sf_dir):
    """Quote values overridden by statements; trailing figures exist for even assets only."""
    day = _day(spark, sf_dir)
    k = F.col("ticker")
    f = U.historical_features(T.features_at(V.prices(spark, sf_dir), day), V.annual(spark, sf_dir), V.dividends(spark, sf_dir), V.earnings(spark, sf_dir), first_quarter=None)
    null = F.lit(None).cast("double")
    absent = ["q_market_cap", "q_price_to_book", "q_return_on_assets", "q_profit_margin", "q_revenue_growth", "q_debt_to_equity", "q_current_ratio",
              "q_free_cashflow", "q_payout_ratio", "q_eps_surprise", "q_current_price", "q_regular_price"]
    quotes = V.profiles(spark, sf_dir).select(
        "ticker", F.when(k % 3 != 0, k % 40 + 5.0).alias("q_trailing_pe"), ((k % 50) / 100.0).alias("q_earnings_growth"), F.when(k % 4 == 0, 0.2).alias("q_return_on_equity"),
        F.lit(3.5).alias("q_dividend_yield"), (k * 10.0).alias("q_operating_cashflow"), (-(k * 4.0)).alias("q_capex"), *[null.alias(c) for c in absent])
    ttm = U.ttm_facts(V.quarterly(spark, sf_dir), _FLOWS, _BALANCES).drop("as_of").filter(k % 2 == 0)
    d = U.live_features(quotes, f.select("ticker", "price"), f.select("ticker", *U.LAGGED), ttm, f.select("ticker", "ttm_div"), f.select("ticker", "eps_surprise"))
    return d.select("ticker", *rounded(d, "peg_ratio", "earnings_growth", "return_on_equity", "dividend_yield", digits=5), rnd("free_cashflow", 2).alias("free_cashflow"))


@query("provider_ratios", "FUN-13 AGG-5", compose(
    f"""SELECT ticker, {r("(total_debt / equity) * 100e0", 4)} AS debt_to_equity, {r("CASE WHEN ticker % 2 = 0 THEN shares ELSE market_cap / price END", 2)} AS shares, {r("fcf / shares * CASE WHEN ticker % 2 = 0 THEN shares ELSE market_cap / price END", 2)} AS free_cashflow
 FROM classic_features WHERE snapshot = (SELECT MAX(snapshot) FROM snaps) AND equity <> 0 AND ticker % 5 <> 0"""))
def provider_ratios(spark, sf_dir):
    from ..plans import evaluate as E
    from .evaluation import CFG, market, stocks
    m = market(spark, sf_dir)
    last = E.dates_of(m, CFG).select(F.slice("dates", -1, 1).alias("dates"))
    f = E.snapshot_features(m, CFG, last).join(stocks(spark, sf_dir), "ticker", "left_semi").filter("equity <> 0")
    raw = f.select("ticker", "price", "market_cap", F.lit(None).cast("double").alias("mkt_cap"), F.when(F.col("ticker") % 2 == 0, F.col("shares")).alias("shares_outstanding"),
                   F.col("trailing_pe").alias("pe"), F.col("price_to_book").alias("pb"), F.col("peg_ratio").alias("peg"), F.try_divide("total_debt", "equity").alias("debt_to_equity_ratio"),
                   F.try_divide("fcf", "shares").alias("fcf_per_share"))
    d = U.provider_ratio_features(raw)
    return d.select("ticker", rnd("debt_to_equity", 4).alias("debt_to_equity"), *rounded(d, "shares", "free_cashflow", digits=2))


@query("surprise_from_actuals", "AGG-5 SRC-11", compose(
    f"SELECT ticker, {r('AVG(CASE WHEN eps_estimate <> 0 THEN (eps_reported - eps_estimate) * 1e0 / ABS(eps_estimate) * 100e0 END)', 5)} AS eps_surprise FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY reported_at DESC) AS k FROM earnings) WHERE k <= 4 GROUP BY 1"))
def surprise_from_actuals(spark, sf_dir):
    e = V.earnings(spark, sf_dir).select("ticker", F.col("reported_at").alias("date"), F.col("eps_reported").cast("double").alias("actual"), F.col("eps_estimate").cast("double").alias("estimate"))
    return RD.surprise_from_actuals(e).select("ticker", F.round("eps_surprise", 5).alias("eps_surprise"))


@query("dividend_fallback", "AGG-3 SRC-10", compose(
    "SELECT ticker, CASE WHEN COUNT(CASE WHEN k <= 4 THEN amt END) = 4 THEN SUM(CASE WHEN k <= 4 THEN amt END) ELSE 7e0 END AS ttm_div FROM (SELECT ticker, CASE WHEN amount <> 5 THEN amount * 1e0 END AS amt, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ex_date DESC) AS k FROM dividends) GROUP BY 1"))
def dividend_fallback(spark, sf_dir):
    """A quarterly payment of 5 is treated as unknown: those tickers fall back to the annual row of 7."""
    q = V.dividends(spark, sf_dir).select("ticker", F.lit("quarterly").alias("kind"), F.col("ex_date").alias("paid_on"), F.when(F.col("amount") != 0.05, (F.col("amount") * 100).cast("double")).alias("amount"))
    a = V.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.lit("annual").alias("kind"), F.lit("2001-12-31").cast("date").alias("paid_on"), F.lit(7.0).alias("amount"))
    return U.quarterly_or_annual_dividend(q.unionByName(a.join(q.select("ticker").distinct(), "ticker", "left_semi")))


# ---- payloads ---------------------------------------------------------------------------------------

@query("insight_trends", "FUN-14 SRC-17 WIN-25", compose(
    f"""SELECT ticker, MAX(period_end) AS latest, {r("MAX_BY(nm, period_end)")} AS net_margin, CASE WHEN COUNT(nm) < 2 THEN NULL WHEN ABS(MAX_BY(nm, period_end) - MIN_BY(nm, period_end)) <= 0.005e0 THEN 'flat' WHEN MAX_BY(nm, period_end) > MIN_BY(nm, period_end) THEN 'up' ELSE 'down' END AS margin_trend,
 CASE WHEN COUNT(revenue) < 2 THEN NULL WHEN ABS(MAX_BY(revenue, period_end) - MIN_BY(revenue, period_end)) <= 0.03e0 * ABS(MIN_BY(revenue, period_end)) THEN 'flat' WHEN MAX_BY(revenue, period_end) > MIN_BY(revenue, period_end) THEN 'up' ELSE 'down' END AS revenue_trend FROM (
 SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, revenue, net_income / revenue AS nm FROM annual) GROUP BY 1"""))
def insight_trends(spark, sf_dir):
    """Chart payloads per ticker (periods and parallel series) back to fiscal rows and their trends."""
    a = V.annual(spark, sf_dir).select("ticker", F.col("period_end").cast("string").alias("p"), "revenue", (F.col("net_income") / F.col("revenue")).alias("nm"))
    rows = a.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("p", "revenue", "nm"))).alias("x"))
    def one(label: str, field: str):
        return F.struct(F.lit(label).alias("name"), F.transform("x", lambda e: e[field]).alias("data"))
    periods = F.transform("x", lambda e: e["p"]).alias("periods")
    charts = rows.select("ticker", F.to_json(F.struct(periods, F.array(one("Revenue", "revenue")).alias("series"))).alias("chart")).unionByName(
        rows.select("ticker", F.to_json(F.struct(periods, F.array(one("Net Margin", "nm")).alias("rates"))).alias("chart")))
    d = RD.insight_periods(charts)
    ends = lambda c: (F.min_by(c, F.when(F.col(c).isNotNull(), F.col("period_end"))), F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_end"))))
    (m0, m1), (r0, r1) = ends("net_margin"), ends("revenue")
    return d.groupBy("ticker").agg(F.max("period_end").alias("latest"), F.round(F.max_by("net_margin", "period_end"), 6).alias("net_margin"),
                                   MC.trend_direction(m0, m1, F.count("net_margin"), min_delta=0.005).alias("margin_trend"),
                                   MC.trend_direction(r0, r1, F.count("revenue"), min_rel=0.03).alias("revenue_trend"))


@query("page_links", "SRC-12", """SELECT page_id, href, MIN(pos) AS first_pos, COUNT(*) AS times FROM (SELECT page_id, UNNEST(l) AS href, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM (
 SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS l FROM pages)) GROUP BY 1, 2""")
def page_links(spark, sf_dir):
    return RD.page_links(V.read(spark, sf_dir, "pages"))


@query("event_payload_points", "SRC-5", """SELECT event_type AS ticker, CAST(ts AS DATE) AS session, COUNT(*) AS points, ROUND(SUM(CAST(ROUND(value * 100) AS BIGINT)) / 100e0, 2) AS total FROM events GROUP BY 1, 2""")
def event_payload_points(spark, sf_dir):
    """Ticks as [[epoch_ms, value], ...] payloads, read back to sessions."""
    e = V.read(spark, sf_dir, "events")
    # a payload carries at most a thousand points, however many events a key has
    points = e.groupBy(F.col("event_type").alias("ticker"), F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.collect_list(F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("double"), F.col("value"))).alias("data"))
    d = RD.price_points(points.select("ticker", "data"))
    return d.groupBy("ticker", "session").agg(F.count("*").alias("points"), F.round(F.sum(F.round(F.col("close") * 100).cast("bigint")) / 100.0, 2).alias("total"))
