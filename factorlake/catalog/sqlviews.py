"""The driver views and derived tables again, as plain SQL for the cross-check engine.

``compose(body)`` prepends exactly the views that ``body`` names, in dependency order.
"""

from __future__ import annotations

import re

from ..operators import scoring as S
from ..sources.driver_views import FACTS, SECTORS


def num(x: float) -> str:
    """A double literal (plain decimals would be exact decimals in SQL)."""
    return f"({float(x)!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})"


def r(expr: str, digits: int = 6) -> str:
    return f"(ROUND({expr}, {digits}) + 0.0)"


def lin(v: str, best: float, worst: float, default: float = 50.0) -> str:
    span = float(best) - float(worst)
    return (f"(CASE WHEN ({v}) IS NULL THEN {num(default)} ELSE "
            f"GREATEST(0e0, LEAST(100e0, (({v}) - {num(worst)}) / {num(span)} * 100e0)) END)")


def mix(*terms: tuple[str, float]) -> str:
    return "(" + " + ".join(f"{s} * {num(w)}" for s, w in terms) + ")"


def nonneg(v: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN {v} END)"


def pos(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END)"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN (({a}) - ({b})) / ABS({b}) END)"


CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
V: dict[str, str] = {}

V["trades"] = f"""SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS session,
 l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status, {CENTS} AS ext, CAST(l_quantity AS BIGINT) AS qty,
 CAST(ROUND(l_discount * 100) AS BIGINT) AS disc_pct, CAST(ROUND(l_tax * 100) AS BIGINT) AS tax_pct FROM lineitem"""
V["bars"] = "SELECT ticker, session, SUM(ext) AS ext, SUM(qty) AS qty FROM trades GROUP BY 1, 2"
V["prices"] = """SELECT ticker, session, close FROM (SELECT ticker, session, ROW_NUMBER() OVER w AS k,
 CAST(SUM(ext) OVER f AS DOUBLE) / CAST(100 * SUM(qty) OVER f AS DOUBLE) AS close FROM bars
 WINDOW w AS (PARTITION BY ticker ORDER BY session), f AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE k >= 60"""
V["market"] = """SELECT session, close FROM (SELECT session, ROW_NUMBER() OVER (ORDER BY session) AS k,
 CAST(SUM(ext) OVER f AS DOUBLE) / CAST(100 * SUM(qty) OVER f AS DOUBLE) AS close
 FROM (SELECT session, SUM(ext) AS ext, SUM(qty) AS qty FROM trades GROUP BY 1)
 WINDOW f AS (ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE k >= 60"""

_FACT_SQL = f"""SELECT s.*, CAST(ROUND(s_acctbal * 100) AS BIGINT) AS acct FROM sums s JOIN supplier ON s.ticker = s_suppkey"""


def _facts(period: str) -> str:
    part = lambda cond: f"CAST(SUM(CASE WHEN {cond} THEN ext ELSE 0 END) AS BIGINT)"
    return f"""SELECT *, net_income + s_tax // 100 + s_disc // 500 AS ebitda, GREATEST(net_income, 0) // 4 AS income_tax,
 net_income + GREATEST(net_income, 0) // 4 AS pretax_income, net_income + s_tax // 100 AS ebit, total_assets - equity AS total_liabilities,
 CAST(FLOOR(equity / 2.0e0) AS BIGINT) AS retained_earnings, ocf - capex AS fcf FROM (
 SELECT s.ticker, period_end, s_disc, s_tax, s_ext AS revenue, s_ext - s_disc // 100 - s_tax // 100 - (4 * s_ext) // 10 AS gross_profit,
 s_kept - s_disc // 100 - (6 * s_ext) // 10 AS net_income, s_disc // 1000 AS interest_expense, s_qty AS shares,
 s_ext + s_open AS total_assets, s_ext // 10 + 2000 * CAST(ROUND(s_acctbal * 100) AS BIGINT) AS equity, s_a AS total_debt,
 s_half2 AS current_assets, (9 * s_n) // 10 AS current_liabilities, s_half2 // 3 AS cash,
 s_kept - (65 * s_ext) // 100 AS ocf, s_tax // 100 AS capex, s_disc // 2000 AS stock_comp FROM (
 SELECT ticker, {period} AS period_end, CAST(SUM(ext) AS BIGINT) AS s_ext, CAST(SUM(qty) AS BIGINT) AS s_qty,
 CAST(SUM(ext * disc_pct) AS BIGINT) AS s_disc, CAST(SUM(ext * tax_pct) AS BIGINT) AS s_tax,
 {part("flag <> 'R'")} AS s_kept, {part("flag = 'A'")} AS s_a, {part("flag = 'N'")} AS s_n, {part("status = 'O'")} AS s_open,
 {part("month(session) >= 7")} AS s_half2 FROM trades GROUP BY 1, 2) s JOIN supplier ON s.ticker = s_suppkey)"""


V["annual_cents"] = (f"SELECT *, CAST(period_end + CAST(45 + ticker % 60 AS INTEGER) AS DATE) AS date_filed FROM ("
                     + _facts("make_date(year(session), 12, 31)") + ")")
V["quarterly_cents"] = _facts("CAST(date_trunc('quarter', session) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)")
_units = ", ".join(f"{f} / 100e0 AS {f}" for f in FACTS if f != "shares")
_eps = "CASE WHEN shares <> 0 THEN (net_income / 100e0) / CAST(shares AS DOUBLE) END AS eps"
V["annual"] = f"SELECT ticker, period_end, date_filed, CAST(shares AS DOUBLE) AS shares, {_units}, {_eps} FROM annual_cents"
V["quarterly"] = f"SELECT ticker, period_end, CAST(shares AS DOUBLE) AS shares, {_units}, {_eps} FROM quarterly_cents"
V["dividends"] = "SELECT ticker, session AS ex_date, CAST(SUM(disc_pct) AS BIGINT) AS amount FROM trades WHERE flag = 'N' AND line = 1 GROUP BY 1, 2"
V["earnings"] = """SELECT ticker, CAST(quarter_end + 30 AS DATE) AS reported_at, eps_estimate, eps_reported,
 CAST(eps_reported - eps_estimate AS DOUBLE) / CAST(ABS(eps_estimate) AS DOUBLE) * 100e0 AS surprise_pct FROM (
 SELECT ticker, quarter_end, eps_reported, LAG(eps_reported) OVER (PARTITION BY ticker ORDER BY quarter_end) AS eps_estimate FROM (
 SELECT ticker, CAST(date_trunc('quarter', session) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
 CAST(SUM(ext) AS BIGINT) AS eps_reported FROM trades GROUP BY 1, 2))"""
_sectors = "[" + ", ".join(f"'{s}'" for s in SECTORS) + "]"
V["profiles"] = f"""SELECT s_suppkey AS ticker, 'T' || s_suppkey || (CASE r_name WHEN 'AMERICA' THEN '' WHEN 'EUROPE' THEN '.DE' WHEN 'ASIA' THEN '.T'
 WHEN 'AFRICA' THEN '.L' ELSE '.AX' END) AS symbol, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'ETF' ELSE 'STOCK' END AS asset_type,
 n_name AS nation, r_name AS region, CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'JPY' WHEN 'AFRICA' THEN 'GBP' END AS currency,
 {_sectors}[s_nationkey % {len(SECTORS)} + 1] AS sector,
 CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 7 % 160) / 100e0 END AS expense_ratio,
 CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 37 % 1000 + 1) * 250000000e0 END AS total_assets,
 CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 13 % 300) / 100e0 END AS beta_3y,
 CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 17 % 40 - 10) / 100e0 END AS three_year_return,
 CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 11 % 30 - 8) / 100e0 END AS five_year_return,
 CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 3 % 6) / 100e0 END AS fund_yield
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
V["universe"] = """SELECT CASE WHEN asset_type = 'ETF' THEN k + 4 ELSE k END AS pool, CASE WHEN asset_type = 'ETF' THEN 'etfs' ELSE 'stocks' END AS asset_class,
 reg AS region, ticker AS ord, 'T' || ticker AS ticker FROM (SELECT *, CASE reg WHEN 'us' THEN 1 WHEN 'eu' THEN 2 ELSE 3 END AS k FROM (
 SELECT *, CASE WHEN region = 'AMERICA' THEN 'us' WHEN region IN ('EUROPE', 'AFRICA') THEN 'eu' ELSE 'asia' END AS reg FROM profiles))
 UNION ALL SELECT 4, 'stocks', 'consensus', ticker, 't' || ticker FROM profiles WHERE ticker % 3 = 0 AND asset_type = 'STOCK'"""
V["aliases"] = "SELECT 'T' || s_suppkey AS alias, 'T' || (s_suppkey - 1) AS canonical FROM supplier WHERE s_suppkey % 50 = 7"
V["holdings"] = """SELECT manager, 'S.' || ticker AS symbol, CAST((ext * 10000) // SUM(ext) OVER (PARTITION BY manager) AS BIGINT) AS bps FROM (
 SELECT manager, ticker, ext FROM (SELECT o_custkey % 82 AS manager, date_trunc('quarter', session) AS quarter, ticker, CAST(SUM(ext) AS BIGINT) AS ext, MAX(date_trunc('quarter', session)) OVER (PARTITION BY o_custkey % 82) AS newest
 FROM trades JOIN orders ON orderkey = o_orderkey GROUP BY 1, 2, 3) WHERE quarter = newest)"""
V["customer_shares"] = """SELECT ticker, period_end, party, value, total, CAST(value AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM (
 SELECT ticker, make_date(year(session), 12, 31) AS period_end, n_name AS party, CAST(SUM(ext) AS BIGINT) AS value,
 CAST(SUM(SUM(ext)) OVER (PARTITION BY ticker, make_date(year(session), 12, 31)) AS BIGINT) AS total FROM trades JOIN orders ON orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
V["product_sales"] = """SELECT ticker, year(session) AS fiscal_year, p_type AS product, CAST(SUM(ext) AS BIGINT) AS value
 FROM trades JOIN part ON partkey = p_partkey GROUP BY 1, 2, 3"""
V["index_series"] = """SELECT event_type AS symbol, CAST(ts AS DATE) AS session,
 CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * COUNT(*) AS DOUBLE) AS close FROM events GROUP BY 1, 2"""

# --- price features at every bar
V["px"] = """SELECT *, ROW_NUMBER() OVER w AS n, LAG(close) OVER w AS prev, close / LAG(close) OVER w - 1 AS ret,
 GREATEST(close - LAG(close) OVER w, 0e0) AS gain, GREATEST(LAG(close) OVER w - close, 0e0) AS loss, LEAD(session) OVER w AS next
 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY session)"""
V["ema"] = f"""SELECT ticker, n, close, close AS fast, close AS slow, 0e0 AS sig FROM px WHERE n = 1
 UNION ALL SELECT p.ticker, p.n, p.close, e.fast * (1 - 2e0/13) + p.close * (2e0/13), e.slow * (1 - 2e0/27) + p.close * (2e0/27),
 e.sig * (1 - 2e0/10) + ((e.fast * (1 - 2e0/13) + p.close * (2e0/13)) - (e.slow * (1 - 2e0/27) + p.close * (2e0/27))) * (2e0/10)
 FROM ema e JOIN px p ON p.ticker = e.ticker AND p.n = e.n + 1"""
V["tech0"] = """SELECT *, CASE WHEN n >= 200 THEN AVG(close) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS sma200,
 STDDEV_SAMP(ret) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 250 PRECEDING AND CURRENT ROW) AS sd,
 AVG(gain) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ag,
 AVG(loss) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS al FROM px"""
V["tech"] = """SELECT ticker, session, next, close, n, close / prev - 1 AS daily_change, close / LAG(close, 21) OVER w - 1 AS return_1m,
 close / LAG(close, 63) OVER w - 1 AS return_3m, close / LAG(close, 126) OVER w - 1 AS return_6m, close / LAG(close, 251) OVER w - 1 AS return_12m,
 sma200, close / sma200 - 1 AS price_vs_sma200, sma200 / LAG(sma200, 125) OVER w - 1 AS sma200_slope,
 CASE WHEN n >= 252 THEN sd * SQRT(252e0) END AS volatility_1y, CASE WHEN n >= 60 THEN sd * SQRT(252e0) END AS volatility_research,
 CASE WHEN n < 35 THEN NULL WHEN al = 0 THEN 100e0 ELSE 100e0 - 100e0 / (ag / al + 1e0) END AS rsi_14,
 CASE WHEN n >= 2 THEN MIN(close) OVER y END AS week52_low, CASE WHEN n >= 2 THEN MAX(close) OVER y END AS week52_high,
 CASE WHEN n >= 2 THEN close / MAX(close) OVER y - 1 END AS pct_off_high FROM tech0
 WINDOW w AS (PARTITION BY ticker ORDER BY session),
 y AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"""
V["macd"] = """SELECT ticker, n, CASE WHEN n >= 35 THEN (fast - slow) / close END AS macd_line,
 CASE WHEN n >= 35 THEN ((fast - slow) - sig) / close END AS macd_histogram FROM ema"""

# --- snapshot dates (60 days lag, 5 years, 3 months, room for 366 days)
V["common"] = "SELECT MIN(s) AS latest_common FROM (SELECT ticker, MAX(session) AS s FROM trades GROUP BY 1)"
V["steps"] = """SELECT CAST(latest_common - 60 AS DATE) AS d, CAST(latest_common - 60 - 1826 AS DATE) AS first_day FROM common
 UNION ALL SELECT CAST(d - INTERVAL 3 MONTH AS DATE), first_day FROM steps WHERE CAST(d - INTERVAL 3 MONTH AS DATE) >= first_day"""
V["snaps"] = "SELECT d AS snapshot FROM steps, common WHERE CAST(d + 366 AS DATE) <= latest_common"
_carry = ("daily_change, return_1m, return_3m, return_6m, return_12m, price_vs_sma200, sma200_slope, volatility_1y, "
          "volatility_research, rsi_14, week52_low, week52_high, pct_off_high")
V["snaprows"] = f"""SELECT t.ticker, snapshot, t.session, t.close AS price, t.n AS bars, {_carry}, macd_line, macd_histogram
 FROM tech t JOIN macd m ON m.ticker = t.ticker AND m.n = t.n JOIN snaps ON snapshot >= t.session AND (t.next IS NULL OR snapshot < t.next)"""
V["latest"] = f"""SELECT t.ticker, t.session, t.close AS price, t.n AS bars, {_carry}, macd_line, macd_histogram
 FROM tech t JOIN macd m ON m.ticker = t.ticker AND m.n = t.n WHERE t.next IS NULL"""


def _fund(visible: str, cutoff: str, div_anchor: str) -> str:
    pick = lambda f, k: f"MAX(CASE WHEN k = {k} THEN {f} END)"
    from ..operators.fundamentals import LAGGED
    cols = ", ".join(f"{pick(f, k + 1)} AS {name}" for name, (f, k) in LAGGED.items())
    return f"""SELECT g.*, f.* EXCLUDE (ticker, snapshot), COALESCE(dv.ttm, 0) / 100e0 AS ttm_div, es.eps_surprise FROM
 (SELECT *, {cutoff} AS quarter FROM snaprows) g
 LEFT JOIN (SELECT ticker, snapshot, {cols} FROM (SELECT g.ticker AS tk, g.snapshot, a.*, ROW_NUMBER() OVER (PARTITION BY g.ticker, g.snapshot ORDER BY a.period_end DESC) AS k
   FROM (SELECT ticker, snapshot, {cutoff} AS quarter FROM snaprows) g JOIN annual a ON a.ticker = g.ticker AND {visible}) GROUP BY 1, 2) f ON f.ticker = g.ticker AND f.snapshot = g.snapshot
 LEFT JOIN (SELECT g.ticker, g.snapshot, SUM(amount) AS ttm FROM (SELECT ticker, snapshot, {cutoff} AS quarter FROM snaprows) g JOIN dividends d
   ON d.ticker = g.ticker AND ex_date >= CAST({div_anchor} - 365 AS DATE) AND ex_date < {div_anchor} GROUP BY 1, 2) dv ON dv.ticker = g.ticker AND dv.snapshot = g.snapshot
 LEFT JOIN surprises es ON es.ticker = g.ticker AND es.snapshot = g.snapshot"""


V["surprises"] = """SELECT ticker, snapshot, AVG(surprise_pct) AS eps_surprise FROM (SELECT snaprows.ticker, snapshot, surprise_pct,
 ROW_NUMBER() OVER (PARTITION BY snaprows.ticker, snapshot ORDER BY reported_at DESC) AS k FROM snaprows JOIN earnings e
 ON e.ticker = snaprows.ticker AND reported_at <= CAST(snapshot - 60 AS DATE) AND surprise_pct IS NOT NULL) WHERE k <= 4 GROUP BY 1, 2"""
QUARTER = ("(CASE WHEN CAST(date_trunc('quarter', snapshot - 60) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) <= CAST(snapshot - 60 AS DATE) "
           "THEN CAST(date_trunc('quarter', snapshot - 60) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) "
           "ELSE CAST(date_trunc('quarter', snapshot - 60) - INTERVAL 1 DAY AS DATE) END)")
V["inputs_classic"] = _fund("a.period_end <= g.quarter", QUARTER, "g.quarter")
V["inputs_filed0"] = _fund("a.date_filed <= g.snapshot", "snapshot", "g.snapshot")
V["inputs_filed"] = """SELECT * EXCLUDE (shares), COALESCE(shares, CASE WHEN eps <> 0 AND ni / eps > 0 THEN ni / eps END) AS shares FROM inputs_filed0"""


def derived(source: str, ni: str = "ni", rev: str = "rev", eps: str = "eps", gp: str = "gross_profit", ta: str = "total_assets") -> str:
    """Feature SQL; the keyword columns feed the year-over-year comparisons."""
    bvps = "(CASE WHEN equity > 0 AND shares > 0 THEN equity / shares END)"
    pe = pos("price", "eps")
    eg = pct(ni, "ni_prev")
    better = lambda a, b, c, d: f"(CASE WHEN {b} > 0 AND {d} > 0 THEN {a} / {b} > {c} / {d} END)"
    return f"""SELECT *, {pe} AS trailing_pe, {pos("price", bvps)} AS price_to_book,
 CASE WHEN {pe} > 0 AND {eg} > 0 AND {eg} <= 1 THEN {pe} / ({eg} * 100e0) END AS peg_ratio,
 {pos("ni", "equity")} AS return_on_equity, {pos("ni", "total_assets")} AS return_on_assets, {pos("ni", "rev")} AS profit_margin,
 {eg} AS earnings_growth, CASE WHEN {ni} > 0 AND ni_prev2 > 0 THEN SQRT({ni} / ni_prev2) - 1 END AS earnings_cagr_2y,
 {pct(rev, "rev_prev")} AS revenue_growth, {pos(f"{ta} - total_assets_prev", "total_assets_prev")} AS asset_growth,
 {better(gp, rev, "gross_profit_prev", "rev_prev")} AS margin_improving,
 {better(ni, ta, "ni_prev", "total_assets_prev")} AS roa_improving,
 {pos("total_debt", "equity")} * 100e0 AS debt_to_equity, {pos("curr_assets", "curr_liab")} AS current_ratio, fcf AS free_cashflow,
 {pos("ttm_div", "price")} AS dividend_yield, CASE WHEN ttm_div <> 0 AND eps <> 0 THEN ttm_div / eps END AS payout_ratio,
 {pct(eps, "eps_prev")} - {pct("eps_prev", "eps_prev2")} AS eps_acceleration,
 CASE WHEN price <> 0 AND shares <> 0 THEN price * shares END AS market_cap FROM {source}"""


V["classic_features"] = derived("inputs_classic")
V["filed_features"] = derived("inputs_filed")

# --- factor expressions
TECHNICAL = mix((lin("CASE WHEN rsi_14 IS NOT NULL THEN GREATEST(rsi_14, 20e0) END", 35, 65), 0.375), (lin("macd_histogram", 0.05, -0.05), 0.625))
PE, PB, PEG = lin(nonneg("trailing_pe"), 10, 40), lin(nonneg("price_to_book"), 1, 6), lin(nonneg("peg_ratio"), 0.8, 3)
FCFY = pos("free_cashflow", "market_cap")
R12X1 = "(CASE WHEN return_1m > -0.99e0 THEN (return_12m + 1e0) / (return_1m + 1e0) - 1e0 ELSE return_12m END)"
IMPROVE = ("(CASE WHEN margin_improving IS NOT NULL AND roa_improving IS NOT NULL THEN (CASE WHEN margin_improving THEN 100e0 ELSE 0e0 END + "
           "CASE WHEN roa_improving THEN 100e0 ELSE 0e0 END) / 2e0 WHEN margin_improving IS NOT NULL THEN CASE WHEN margin_improving THEN 100e0 ELSE 0e0 END "
           "WHEN roa_improving IS NOT NULL THEN CASE WHEN roa_improving THEN 100e0 ELSE 0e0 END ELSE 50e0 END)")
PVS, SLOPE = lin("price_vs_sma200", 0.15, -0.20), lin("sma200_slope", 0.10, -0.10)
MOMENTUM = mix((PVS, 0.35), (lin(R12X1, 0.30, -0.20), 0.40), (SLOPE, 0.25))
QUANT = {
    "value": mix((PE, 0.35), (PB, 0.20), (PEG, 0.25), (lin(FCFY, 0.10, 0.0), 0.20)),
    "growth": mix((lin("earnings_growth", 0.25, -0.05), 0.55), (lin("revenue_growth", 0.20, -0.05), 0.45)),
    "profitability": mix((lin("return_on_equity", 0.30, 0.05), 0.30), (lin("profit_margin", 0.25, 0.02), 0.25),
                         (lin("return_on_assets", 0.15, 0.01), 0.15), (IMPROVE, 0.30)),
    "momentum": mix((MOMENTUM, 0.70), (TECHNICAL, 0.30)),
    "eps_revisions": lin("eps_surprise", 15, -15),
    "asset_growth": lin("asset_growth", -0.05, 0.30),
}
DISQUALIFIED = "(f_growth < 20 OR f_momentum < 20 OR f_eps_revisions < 20 OR f_value < 15 OR f_profitability < 15)"


def quant_factors(source: str) -> str:
    return "SELECT *, " + ", ".join(f"{e} AS f_{n}" for n, e in QUANT.items()) + f" FROM {source}"


def weighted(weights: dict[str, float], factors=None) -> str:
    return "(" + " + ".join(f"f_{f} * {num(weights[f])}" for f in (factors or weights)) + ")"


def quant_total(source: str, weights=None) -> str:
    t = weighted(weights or S.QUANT_WEIGHTS, list(S.QUANT_WEIGHTS))
    return f"SELECT *, {DISQUALIFIED} AS disqualified, CASE WHEN {DISQUALIFIED} THEN LEAST({t}, 50e0) ELSE {t} END AS total FROM ({quant_factors(source)})"


V["quant_classic"] = quant_total("(SELECT c.* FROM classic_features c JOIN profiles p ON p.ticker = c.ticker WHERE asset_type = 'STOCK')")
V["quant_filed"] = quant_total("(SELECT c.* FROM filed_features c JOIN profiles p ON p.ticker = c.ticker WHERE asset_type = 'STOCK')")


def _asof(name: str, days: int) -> str:
    return (f"(SELECT p.close FROM px p WHERE p.ticker = s.ticker AND p.session <= CAST(s.snapshot + {days} AS DATE) ORDER BY p.session DESC LIMIT 1) AS {name}")


V["fwd"] = """SELECT a.ticker, a.snapshot, CASE WHEN a.price > 0 THEN p6.close / a.price - 1 END AS r6, CASE WHEN a.price > 0 THEN p12.close / a.price - 1 END AS r12
 FROM snaprows a JOIN px p6 ON p6.ticker = a.ticker AND a.snapshot + 183 >= p6.session AND (p6.next IS NULL OR a.snapshot + 183 < p6.next)
 JOIN px p12 ON p12.ticker = a.ticker AND a.snapshot + 366 >= p12.session AND (p12.next IS NULL OR a.snapshot + 366 < p12.next)"""
V["mk"] = "SELECT session, close, LEAD(session) OVER (ORDER BY session) AS next FROM market"
V["bench"] = """SELECT snapshot, m6.close / m0.close - 1 AS b6, m12.close / m0.close - 1 AS b12 FROM snaps
 JOIN mk m0 ON snapshot >= m0.session AND (m0.next IS NULL OR snapshot < m0.next)
 JOIN mk m6 ON snapshot + 183 >= m6.session AND (m6.next IS NULL OR snapshot + 183 < m6.next)
 JOIN mk m12 ON snapshot + 366 >= m12.session AND (m12.next IS NULL OR snapshot + 366 < m12.next)"""


def metrics_sql(source: str, group: str) -> str:
    """Evaluation measures over rows (group, snapshot, r6, r12, b6, b12) for the cross-check."""
    g = group + ", " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    sh = lambda c: (f"CASE WHEN COUNT({c}) >= 2 AND STDDEV_SAMP({c}) > 0 THEN (AVG({c}) - 0.0225e0) / STDDEV_SAMP({c}) * SQRT(2e0) ELSE 0e0 END")
    n6, n12 = "COUNT(p)", "COUNT(CASE WHEN r12 IS NOT NULL AND b12 IS NOT NULL THEN 1 END)"
    return f"""SELECT {g}CAST(COUNT(*) AS BIGINT) AS snapshots, CAST({n6} AS BIGINT) AS n6, CAST({n12} AS BIGINT) AS n12,
 MAX_BY(cum, snapshot) - 1 AS cumulative_return, MAX_BY(bcum, snapshot) - 1 AS benchmark_return, {sh("p")} AS sharpe, {sh("q")} AS benchmark_sharpe,
 CAST(COUNT(CASE WHEN p > q THEN 1 END) AS DOUBLE) / GREATEST({n6}, 1) AS win_rate_6m,
 CAST(COUNT(CASE WHEN r12 > b12 THEN 1 END) AS DOUBLE) / GREATEST({n12}, 1) AS win_rate_12m, ABS(MIN(dd)) AS max_drawdown,
 CASE WHEN MAX_BY(bcum, snapshot) > 0 THEN POW(MAX_BY(cum, snapshot) / MAX_BY(bcum, snapshot), 1e0 / GREATEST({n6} / 2e0, 1e0)) - 1 ELSE 0e0 END AS alpha
 FROM (SELECT *, (cum - GREATEST(1e0, MAX(cum) OVER ({part}ORDER BY snapshot))) / GREATEST(1e0, MAX(cum) OVER ({part}ORDER BY snapshot)) AS dd FROM (
 SELECT *, PRODUCT(COALESCE(p, 0e0) + 1e0) OVER ({part}ORDER BY snapshot) AS cum, PRODUCT(COALESCE(q, 0e0) + 1e0) OVER ({part}ORDER BY snapshot) AS bcum FROM (
 SELECT *, CASE WHEN r6 IS NOT NULL AND b6 IS NOT NULL THEN r6 END AS p, CASE WHEN r6 IS NOT NULL AND b6 IS NOT NULL THEN b6 END AS q FROM {source}))) {"GROUP BY " + group if group else ""}"""


#: Views that read themselves.
RECURSIVE = ("ema", "steps", "hold", "walk")
#: Names that are also column names need the view to be read after FROM or JOIN.
_READ = re.compile(r"(?:FROM|JOIN|,)\s*\(*\s*([A-Za-z_][A-Za-z_0-9]*)", re.IGNORECASE)


def _needs(sql: str) -> set[str]:
    return {m for m in _READ.findall(sql) if m in V}


def compose(body: str, **extra: str) -> str:
    """``body`` with the views it reads in front; ``extra`` adds views local to one query."""
    order: list[str] = []
    local = {**V, **extra}

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in order or name in trail:
            return
        for dep in sorted(m for m in _READ.findall(local[name]) if m in local):
            visit(dep, (*trail, name))
        order.append(name)
    for name in sorted(m for m in _READ.findall(body) if m in local):
        visit(name, ())
    if not order:
        return body
    ctes = ", ".join(f"{n} AS MATERIALIZED ({local[n]})" if n not in RECURSIVE else f"{n} AS ({local[n]})" for n in order)
    return f"WITH RECURSIVE {ctes} {body}"
