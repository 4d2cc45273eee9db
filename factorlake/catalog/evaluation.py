"""Fundamental features, factor scores and evaluations at the snapshot dates."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..operators import metrics as M, scoring as S
from ..plans import evaluate as E, research as Q
from ..session import stable
from ..sources import driver_views as V
from . import sqlviews as X
from .registry import query, rnd, rounded
from .sqlviews import compose, r

CFG = E.EvalConfig(first_quarter=None)
FILED = E.EvalConfig(first_quarter=None, clock="filed")


def market(spark, sf_dir) -> E.Market:
    return E.Market(V.prices(spark, sf_dir), V.last_sessions(spark, sf_dir), V.annual(spark, sf_dir), V.dividends(spark, sf_dir),
                    V.earnings(spark, sf_dir), V.market_prices(spark, sf_dir))


def stocks(spark, sf_dir):
    return V.profiles(spark, sf_dir).filter("asset_type = 'STOCK'").select("ticker")


def features(spark, sf_dir, cfg=CFG):
    return E.snapshot_features(market(spark, sf_dir), cfg).join(stocks(spark, sf_dir), "ticker", "left_semi")


def ranked(spark, sf_dir, cfg=CFG):
    return E.scored(features(spark, sf_dir, cfg), cfg)


_FEAT = ("trailing_pe", "price_to_book", "peg_ratio", "return_on_equity", "return_on_assets", "profit_margin", "earnings_growth",
         "earnings_cagr_2y", "revenue_growth", "asset_growth", "debt_to_equity", "current_ratio", "dividend_yield", "payout_ratio",
         "eps_acceleration", "eps_surprise")
_FLAGS = ("margin_improving", "roa_improving")
_FCOLS = "ticker, snapshot, " + ", ".join(f"{r(c)} AS {c}" for c in _FEAT) + ", " + ", ".join(_FLAGS) + f", {r('market_cap', 2)} AS market_cap"


def _feature_cols(d):
    return d.select("ticker", "snapshot", *rounded(d, *_FEAT), *_FLAGS, rnd("market_cap", 2).alias("market_cap"))


@query("fixed_lag_features", "FUN-4 FUN-5 JOIN-2 JOIN-3 JOIN-6 JOIN-7 AGG-2 AGG-3 AGG-4 SCL-M4 SCL-M5 SCL-M6 SCL-M7 SCL-M13",
       compose(f"SELECT {_FCOLS} FROM classic_features WHERE ticker % 5 <> 0"))
def fixed_lag_features(spark, sf_dir):
    return _feature_cols(features(spark, sf_dir))


@query("filing_date_features", "FUN-6 JOIN-4 JOIN-6 JOIN-7", compose(f"SELECT {_FCOLS} FROM filed_features WHERE ticker % 5 <> 0"))
def filing_date_features(spark, sf_dir):
    return _feature_cols(features(spark, sf_dir, FILED))


@query("path_choice", "JOIN-23", compose(f"SELECT {_FCOLS}, path FROM (SELECT *, 'filed' AS path FROM filed_features WHERE ticker % 2 = 0 "
                                         "UNION ALL BY NAME SELECT *, 'fixed' AS path FROM classic_features WHERE ticker % 2 = 1)"))
def path_choice(spark, sf_dir):
    """Filings exist for even assets only; the others keep the fixed-lag path."""
    m = market(spark, sf_dir)
    filings = m.annual.filter(F.col("ticker") % 2 == 0)
    at = stable(E.price_rows(m, CFG))
    classic = E.with_fundamentals(at, m, CFG).withColumn("path", F.lit("fixed"))
    filed = E.with_fundamentals(at, m, FILED).withColumn("path", F.lit("filed"))
    keep = ["ticker", "snapshot", "path", *_FEAT, *_FLAGS, "market_cap"]
    d = E.choose_path(classic.select(*keep), filed.select(*keep), filings)
    return d.select("ticker", "snapshot", "path", *rounded(d, *_FEAT), *_FLAGS, rnd("market_cap", 2).alias("market_cap"))


_Q = [f"f_{f}" for f in S.QUANT_WEIGHTS]


@query("quant_scores", "SCO-1 SCO-2 SCO-3 SCO-4 SCO-5 SCO-6 SCO-7 SCO-8", compose(
    "SELECT ticker, snapshot, " + ", ".join(f"{r(c, 5)} AS {c}" for c in [*_Q, "total"]) + ", disqualified FROM quant_classic"))
def quant_scores(spark, sf_dir):
    d = ranked(spark, sf_dir)
    return d.select("ticker", "snapshot", *rounded(d, *_Q, "total", digits=5), "disqualified")


_CL = {"quality": X.mix((X.lin("return_on_equity", .30, .05), .35), (X.lin("profit_margin", .25, .02), .25), (X.lin("earnings_growth", .25, -.05), .25), (X.lin("revenue_growth", .20, -.05), .15)),
       "value": X.mix((X.PE, .45), (X.PB, .20), (X.PEG, .35)),
       "health": X.mix((X.lin("CASE WHEN debt_to_equity >= 0 THEN debt_to_equity / 100e0 END", .2, 2.0), .45), (X.lin("current_ratio", 2.5, 1.0), .25),
                       ("(CASE WHEN free_cashflow > 0 THEN 80e0 WHEN free_cashflow IS NOT NULL THEN 20e0 ELSE 50e0 END)", .30)),
       "trend": X.mix((X.PVS, .35), (X.lin("return_12m", .30, -.20), .30), (X.SLOPE, .35))}
_CF = [f"f_{f}" for f in S.CLASSIC_WEIGHTS]
_CLASSIC_SQL = (f"SELECT *, {X.weighted(S.CLASSIC_WEIGHTS)} AS total FROM (SELECT *, " + ", ".join(f"{e} AS f_{n}" for n, e in _CL.items())
                + " FROM classic_features WHERE ticker % 5 <> 0)")


@query("classic_scores", "SCO-9 SCO-12", compose("SELECT ticker, snapshot, " + ", ".join(f"{r(c)} AS {c}" for c in [*_CF, "total"]) + f" FROM ({_CLASSIC_SQL})"))
def classic_scores(spark, sf_dir):
    d = S.score_classic(features(spark, sf_dir), S.uses_technical(None, "classic"))
    return d.select("ticker", "snapshot", *rounded(d, *_CF, "total"))


_EM = ("cumulative_return", "benchmark_return", "sharpe", "benchmark_sharpe", "win_rate_6m", "win_rate_12m", "max_drawdown", "alpha")
_MCOLS = ", ".join(f"{r(c)} AS {c}" for c in _EM)


def _baskets(source: str, group: str, n: int | None = 10) -> str:
    g = group + ", " if group else ""
    cut = f"WHERE k <= {n}" if n else ""
    return (f"(SELECT x.*, b6, b12 FROM (SELECT {g}snapshot, AVG(r6) AS r6, AVG(r12) AS r12, COUNT(*) AS held FROM (SELECT q.*, r6, r12, ROW_NUMBER() OVER "
            f"(PARTITION BY {g}q.snapshot ORDER BY total DESC, q.ticker) AS k FROM {source} q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot) {cut} GROUP BY {g}snapshot) x "
            f"LEFT JOIN bench ON bench.snapshot = x.snapshot)")


@query("snapshot_baskets", "PIP-2 JOIN-14 AGG-6 WIN-14", compose(
    f"SELECT snapshot, {r('r6')} AS r6, {r('r12')} AS r12, {r('b6')} AS b6, {r('b12')} AS b12, held FROM {_baskets('quant_classic', '')}"))
def snapshot_baskets(spark, sf_dir):
    d = E.evaluate_snapshots(market(spark, sf_dir), CFG, stocks(spark, sf_dir))
    return d.select("snapshot", *rounded(d, "r6", "r12", "b6", "b12"), "held")


@query("evaluation_summary", "PIP-2 AGG-8 AGG-9 WIN-15 WIN-16", compose(
    f"SELECT snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql(_baskets('quant_classic', ''), '')})"))
def evaluation_summary(spark, sf_dir):
    d = E.evaluation(market(spark, sf_dir), CFG, stocks(spark, sf_dir))
    return d.select("snapshots", "n6", "n12", *rounded(d, *_EM))


@query("evaluation_on_filing_dates", "PIP-2 FUN-6 FLT-2", compose(
    f"SELECT snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql(_baskets('(SELECT * FROM quant_filed WHERE market_cap >= 3000000)', ''), '')})"))
def evaluation_on_filing_dates(spark, sf_dir):
    cfg = E.EvalConfig(first_quarter=None, clock="filed", min_cap=3_000_000.0)
    d = E.evaluation(market(spark, sf_dir), cfg, stocks(spark, sf_dir))
    return d.select("snapshots", "n6", "n12", *rounded(d, *_EM))


NS = [3, 5, 10, 25]


@query("top_n_sweep", "PIP-3 TOP-2 AGG-19 EXT-1", compose(
    f"SELECT m.n, snapshots, n6, n12, {_MCOLS}, {r('avg_holdings')} AS avg_holdings FROM ({X.metrics_sql('cuts', 'n')}) m JOIN (SELECT n, AVG(held) AS avg_holdings FROM cuts GROUP BY 1) h ON h.n = m.n",
    ranks="SELECT q.ticker, q.snapshot, r6, r12, ROW_NUMBER() OVER (PARTITION BY q.snapshot ORDER BY total DESC, q.ticker) AS k FROM quant_classic q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot",
    cuts="SELECT x.*, b6, b12 FROM (SELECT CAST(n AS BIGINT) AS n, snapshot, AVG(r6) AS r6, AVG(r12) AS r12, COUNT(*) AS held FROM ranks, (SELECT UNNEST([3, 5, 10, 25]) AS n) WHERE k <= n GROUP BY 1, 2) x LEFT JOIN bench ON bench.snapshot = x.snapshot"))
def top_n_sweep(spark, sf_dir):
    m = market(spark, sf_dir)
    d = E.n_sweep(ranked(spark, sf_dir), E.benchmark_returns(m, E.dates_of(m, CFG)), NS)
    return d.select("n", "snapshots", "n6", "n12", *rounded(d, *_EM, "avg_holdings"))


@query("strategy_evaluation", "EXT-1 PIP-3", compose(
    f"SELECT snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql('held5', '')})",
    held5="SELECT x.*, b6, b12 FROM (SELECT snapshot, AVG(r6) AS r6, AVG(r12) AS r12, COUNT(*) AS held FROM (SELECT q.snapshot, r6, r12, ROW_NUMBER() OVER (PARTITION BY q.snapshot ORDER BY total DESC, q.ticker) AS k FROM quant_classic q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot) WHERE k <= 5 GROUP BY 1) x LEFT JOIN bench ON bench.snapshot = x.snapshot"))
def strategy_evaluation(spark, sf_dir):
    """A strategy is any transform of the scored rows; here it holds the best five of every review."""
    m = market(spark, sf_dir)
    d = E.evaluate_strategy(ranked(spark, sf_dir), E.benchmark_returns(m, E.dates_of(m, CFG)), E.top_strategy(5))
    return d.select("snapshots", "n6", "n12", *rounded(d, *_EM))


BANDS = [(5, 10, 1), (5, 15, 2), (10, 20, 2), (10, 10, 1)]


_HOLD = {
    "hranks": "SELECT q.ticker, q.snapshot, r6, r12, ROW_NUMBER() OVER (PARTITION BY q.snapshot ORDER BY total DESC, q.ticker) AS k FROM quant_classic q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot",
    "seqs": "SELECT snapshot, ROW_NUMBER() OVER (ORDER BY snapshot) AS seq FROM snaps",
    "dense": "SELECT t.ticker, s.snapshot, s.seq, COALESCE(h.k, 1000000000) AS k, r6, r12 FROM (SELECT DISTINCT ticker FROM hranks) t CROSS JOIN seqs s LEFT JOIN hranks h ON h.ticker = t.ticker AND h.snapshot = s.snapshot",
    "hold": "SELECT e, x, c, d.ticker, d.snapshot, d.seq, r6, r12, CASE WHEN k <= e THEN 0 END AS misses FROM dense d, (VALUES (5, 10, 1), (5, 15, 2), (10, 20, 2), (10, 10, 1)) b(e, x, c) WHERE d.seq = 1 "
            "UNION ALL SELECT e, x, c, d.ticker, d.snapshot, d.seq, d.r6, d.r12, COALESCE(CASE WHEN misses IS NOT NULL THEN CASE WHEN d.k <= x THEN 0 WHEN misses + 1 < c THEN misses + 1 END END, CASE WHEN d.k <= e THEN 0 END) "
            "FROM hold h JOIN dense d ON d.ticker = h.ticker AND d.seq = h.seq + 1",
    "hbaskets": "SELECT y.*, b6, b12 FROM (SELECT e AS enter, x AS exit, c AS confirm, snapshot, AVG(r6) AS r6, AVG(r12) AS r12, COUNT(*) AS held FROM hold WHERE misses IS NOT NULL GROUP BY ALL) y LEFT JOIN bench ON bench.snapshot = y.snapshot",
}


@query("hysteresis_sweep", "PIP-4 WIN-24 AGG-19", compose(
    f"SELECT m.enter, m.exit, m.confirm, snapshots, n6, n12, {_MCOLS}, {r('avg_holdings')} AS avg_holdings FROM ({X.metrics_sql('hbaskets', 'enter, exit, confirm')}) m "
    "JOIN (SELECT enter, exit, confirm, AVG(held) AS avg_holdings FROM hbaskets GROUP BY ALL) h ON h.enter = m.enter AND h.exit = m.exit AND h.confirm = m.confirm", **_HOLD))
def hysteresis_sweep(spark, sf_dir):
    """Entry and exit bands over one stored ranking; the SQL twin walks the reviews one by one."""
    m = market(spark, sf_dir)
    dates = E.dates_of(m, CFG)
    rk = stable(ranked(spark, sf_dir).select("ticker", "snapshot", "total", "r6", "r12"))
    d = E.hysteresis_sweep(rk, E.benchmark_returns(m, dates), dates, BANDS)
    return d.select("enter", "exit", "confirm", "snapshots", "n6", "n12", *rounded(d, *_EM, "avg_holdings"))


def factor_rows(spark, sf_dir, cfg=CFG):
    """Scored rows with health structs and candidate scores, stored once for the sweeps."""
    d = Q.with_health(features(spark, sf_dir, cfg))
    d = E.scored(d, cfg)
    drop = [c for c in ("_visible", "quarter") if c in d.columns]
    return stable(d.drop(*drop))


def _variant_union(variants: list[dict]) -> str:
    parts = []
    limits = {"full": (20, 15), "soft": (10, 5), "no_growth": (20, 15), "no_value": (20, 15), "none": (0, 0)}
    for v in variants:
        w = {f: v[f"w_{f}"] for f in S.QUANT_WEIGHTS}
        total = X.weighted(w)
        soft, hard = limits[v["cap"]]
        tests = [f"f_momentum < {soft}", f"f_eps_revisions < {soft}", f"f_profitability < {hard}"]
        tests += [] if v["cap"] == "no_growth" else [f"f_growth < {soft}"]
        tests += [] if v["cap"] == "no_value" else [f"f_value < {hard}"]
        hit = "FALSE" if v["cap"] == "none" else "(" + " OR ".join(tests) + ")"
        parts.append(f"SELECT '{v['name']}' AS variant, ticker, snapshot, CASE WHEN {hit} THEN LEAST({total}, 50e0) ELSE {total} END AS total FROM quant_classic")
    return " UNION ALL ".join(parts)


def _sweep(name: str, covers: str, variants: list[dict], ns: list[int]):
    cuts = (f"SELECT x.*, b6, b12 FROM (SELECT variant, CAST(n AS BIGINT) AS n, snapshot, AVG(r6) AS r6, AVG(r12) AS r12 FROM (SELECT q.*, r6, r12, ROW_NUMBER() OVER (PARTITION BY variant, q.snapshot "
            f"ORDER BY total DESC, q.ticker) AS k FROM vtotals q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot), (SELECT UNNEST({ns}) AS n) WHERE k <= n GROUP BY 1, 2, 3) x LEFT JOIN bench ON bench.snapshot = x.snapshot")
    sql = compose(f"SELECT variant, n, snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql('cuts', 'variant, n')})", vtotals=_variant_union(variants), cuts=cuts)

    def run(spark, sf_dir):
        m = market(spark, sf_dir)
        d = E.variant_sweep(ranked(spark, sf_dir), E.benchmark_returns(m, E.dates_of(m, CFG)), variants, ns)
        return d.select("variant", "n", "snapshots", "n6", "n12", *rounded(d, *_EM))
    query(name, covers, sql)(run)


_sweep("weight_sensitivity", "PIP-6 JOIN-19 SCL-M14 EXT-4", S.weight_variants(), [5, 10])
_sweep("cap_rule_sweep", "PIP-7 SCO-17 JOIN-19", S.cap_variants(), [5, 25])


@query("run_comparison", "JOIN-20", compose(
    "SELECT " + ", ".join(f"ROUND(b.{c} - a.{c}, 6) + 0.0 AS delta_{c}" for c in _EM) + ", CASE WHEN b.alpha > a.alpha AND b.sharpe > a.sharpe AND b.win_rate_12m > a.win_rate_12m THEN 'IMPROVED' "
    "WHEN b.alpha > a.alpha OR b.sharpe > a.sharpe THEN 'MIXED' ELSE 'REGRESSED' END AS verdict FROM ma a, mb b",
    ma=X.metrics_sql(_baskets("quant_classic", ""), ""), mb=X.metrics_sql(_baskets("quant_filed", ""), "")))
def run_comparison(spark, sf_dir):
    """Filing dates against the fixed lag."""
    m, st = market(spark, sf_dir), stocks(spark, sf_dir)
    at = stable(E.price_rows(m, CFG))
    before, after = E.evaluation(m, CFG, st, at).withColumn("k", F.lit(1)), E.evaluation(m, FILED, st, at).withColumn("k", F.lit(1))
    d = M.verdict(before, after, ["k"])
    return d.select(*rounded(d, *[f"delta_{c}" for c in _EM]), "verdict")


@query("evaluation_diagnosis", "PIP-2", compose("""SELECT * FROM (SELECT 'whole' AS run, COUNT(*) AS snapshots, CAST(NULL AS VARCHAR) AS error FROM snaps)
 UNION ALL SELECT 'no assets', NULL, 'Empty universe' UNION ALL SELECT 'no benchmark', NULL, 'Could not fetch benchmark MARKET' UNION ALL SELECT 'no bars', NULL, 'No historical data available'
 UNION ALL SELECT 'young assets', NULL, 'Not enough history for any snapshot'"""))
def evaluation_diagnosis(spark, sf_dir):
    """Runs over the whole tables and with one input after the other taken away."""
    m, every = market(spark, sf_dir), stocks(spark, sf_dir)
    young = m.sessions.withColumn("session", F.lit("1993-01-04").cast("date"))
    cases = {"whole": (m, every), "no assets": (m, every.filter("ticker < 0")), "no benchmark": (replace(m, benchmark=m.benchmark.filter("close < 0")), every),
             "no bars": (replace(m, prices=m.prices.filter("close < 0")), every), "young assets": (replace(m, sessions=young), every)}
    runs = [E.diagnosed(a, CFG, b, "MARKET").select(F.lit(name).alias("run"), "snapshots", "error") for name, (a, b) in cases.items()]
    return reduce(lambda x, y: x.unionByName(y), runs)
