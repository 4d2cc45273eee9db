"""Information coefficients, relative scores, tilts, pools, health diagnostics, source comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A, fundamentals as U, metrics as M, ranking as R, scoring as S
from ..plans import evaluate as E, research as Q
from ..session import stable
from ..sources import driver_views as V
from . import sqlviews as X
from .evaluation import CFG, FILED, _EM, _MCOLS, factor_rows, features, market, ranked
from .registry import query, rnd, rounded
from .sqlviews import compose, r

# ---- health diagnostics ------------------------------------------------------------------------
_HEALTH_IN = ["net_income", "total_assets", "ocf", "total_debt", "current_assets", "current_liabilities", "shares", "gross_profit", "revenue"]
_PAIR = "c.{a} / c.{b} {op} p.{a} / p.{b}"
_CHECKS = {
    "roa_positive": "c.net_income / c.total_assets > 0", "ocf_positive": "c.ocf > 0",
    "roa_improving": _PAIR.format(a="net_income", b="total_assets", op=">"), "accruals": "c.ocf > c.net_income",
    "leverage_decreasing": _PAIR.format(a="total_debt", b="total_assets", op="<"),
    "liquidity_improving": _PAIR.format(a="current_assets", b="current_liabilities", op=">"),
    "no_dilution": "c.shares <= p.shares", "margin_improving": _PAIR.format(a="gross_profit", b="revenue", op=">"),
    "turnover_improving": _PAIR.format(a="revenue", b="total_assets", op=">"),
}
_USABLE = "(c.total_assets > 0 AND c.current_liabilities > 0 AND c.revenue > 0 AND p.total_assets > 0 AND p.current_liabilities > 0 AND p.revenue > 0)"
_PIO = ", ".join(f"CASE WHEN {_USABLE} THEN {e} END AS pio_{k}" for k, e in _CHECKS.items())
_SCORE = f"CASE WHEN {_USABLE} THEN CAST(" + " + ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END" for e in _CHECKS.values()) + " AS INTEGER) END"
_Z = ("1.2e0 * (c.current_assets - c.current_liabilities) / c.total_assets + 1.4e0 * c.retained_earnings / c.total_assets + 3.3e0 * c.ebit / c.total_assets"
      " + 0.6e0 * c.equity / c.total_liabilities + c.revenue / c.total_assets")
_ZN = f"CASE WHEN c.total_assets > 0 AND c.total_liabilities > 0 THEN {_Z} END"
# local views of this module's SQL: periods as of a snapshot, joined to the year before
_LOCAL = {
    "asof_q": f"SELECT ticker, snapshot, {X.QUARTER} AS quarter FROM snaprows",
    "seen": "SELECT g.ticker, g.snapshot, a.* EXCLUDE (ticker), ROW_NUMBER() OVER (PARTITION BY g.ticker, g.snapshot ORDER BY a.period_end DESC) AS k FROM asof_q g JOIN annual a ON a.ticker = g.ticker AND a.period_end <= g.quarter",
    "health": f"SELECT c.ticker, c.snapshot, {_SCORE} AS piotroski, {_PIO}, {_ZN} AS altman_z FROM (SELECT * FROM seen WHERE k = 1) c LEFT JOIN (SELECT * FROM seen WHERE k = 2) p ON p.ticker = c.ticker AND p.snapshot = c.snapshot",
}


@query("piotroski_altman", "FUN-11 FUN-12", compose(
    f"SELECT c.ticker, c.period_end, {_SCORE} AS piotroski, {_PIO}, {r(_ZN)} AS altman_z, CASE WHEN z >= 2.99e0 THEN 'safe' WHEN z >= 1.81e0 THEN 'grey' WHEN z IS NOT NULL THEN 'distress' END AS altman_zone "
    f"FROM (SELECT *, {_ZN} AS z, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY period_end) AS k FROM annual c) c LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY period_end) AS k FROM annual) p ON p.ticker = c.ticker AND p.k = c.k - 1"))
def piotroski_altman(spark, sf_dir):
    """Both scores for every fiscal year against the year before."""
    p = A.period_array(V.annual(spark, sf_dir))
    d = p.select("ticker", F.posexplode("periods").alias("i", "cur"), "periods").withColumn("prev", F.get("periods", F.col("i") + 1))
    d = d.withColumn("pio", U.piotroski(F.col("cur"), F.col("prev"))).withColumn("alt", U.altman(F.col("cur")))
    return d.select("ticker", F.col("cur.period_end").alias("period_end"), F.col("pio.score").alias("piotroski"),
                    *[F.col(f"pio.{k}").alias(f"pio_{k}") for k in U.PIOTROSKI_CHECKS], rnd("alt.z_score").alias("altman_z"), F.col("alt.zone").alias("altman_zone"))


# ---- information coefficients ------------------------------------------------------------------
_M = {
    "F_value": "f_value", "F_growth": "f_growth", "F_profitability": "f_profitability", "F_eps_revisions": "f_eps_revisions",
    "F_momentum": X.MOMENTUM, "F_total": "total", "pe": "-trailing_pe", "pb": "-price_to_book",
    "fcf_yield": "CASE WHEN market_cap <> 0 THEN free_cashflow / market_cap END", "roe": "return_on_equity", "profit_margin": "profit_margin",
    "earnings_growth": "earnings_growth", "revenue_growth": "revenue_growth", "eps_surprise": "eps_surprise", "eps_acceleration": "eps_acceleration",
    "peg_derived_NEG": "CASE WHEN trailing_pe > 0 AND earnings_growth > 0 THEN -(trailing_pe / earnings_growth) END", "return_12m": "return_12m",
    "return_12m_ex_1m": "CASE WHEN return_1m > -0.99e0 THEN (return_12m + 1e0) / (return_1m + 1e0) - 1e0 END", "return_6m": "return_6m", "return_3m": "return_3m",
    "return_1m_REV": "-return_1m", "price_vs_sma200": "price_vs_sma200", "sma200_slope": "sma200_slope", "pct_off_52w_high": "pct_off_high",
    "volatility_LOW": "-volatility_research", "rsi_14": "rsi_14", "piotroski": "piotroski", "altman_z": "altman_z",
    **{f"pio_{k}": f"CAST(pio_{k} AS INTEGER)" for k in U.PIOTROSKI_CHECKS},
}
_LONG = " UNION ALL ".join(f"SELECT ticker, snapshot, '{n}' AS metric, CAST({e} AS DOUBLE) AS x, r6 AS y FROM wide" for n, e in _M.items())
_LOCAL["wide"] = ("SELECT q.*, r6, r12, h.* EXCLUDE (ticker, snapshot) FROM quant_classic q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot "
                  "LEFT JOIN health h ON h.ticker = q.ticker AND h.snapshot = q.snapshot")


def _ic(long: str, group: str) -> str:
    rank = lambda v: f"RANK() OVER (PARTITION BY {group} ORDER BY {v}) + (COUNT(*) OVER (PARTITION BY {group}, {v}) - 1) / 2e0"
    # ranks are halves of integers and their mean is (n + 1) / 2, so these sums are exact
    return (f"(SELECT {group}, COUNT(*) AS pairs, SUM(cx * cy) / (SQRT(SUM(cx * cx)) * SQRT(SUM(cy * cy))) AS ic FROM (SELECT *, rx - (m + 1) / 2e0 AS cx, ry - (m + 1) / 2e0 AS cy FROM ("
            f"SELECT *, {rank('x')} AS rx, {rank('y')} AS ry, COUNT(*) OVER (PARTITION BY {group}) AS m FROM (SELECT * REPLACE (x + 0e0 AS x, y + 0e0 AS y) FROM ({long}) WHERE x IS NOT NULL AND y IS NOT NULL))) "
            f"GROUP BY {group} HAVING COUNT(*) >= 5 AND COUNT(DISTINCT x) >= 2 AND COUNT(DISTINCT y) >= 2)")


@query("factor_ic", "PIP-5 WIN-17 SNK-3", compose(f"SELECT snapshot, metric, pairs, {r('ic')} AS ic FROM {_ic('SELECT * FROM longm', 'snapshot, metric')}", **_LOCAL, longm=_LONG))
def factor_ic(spark, sf_dir):
    d = Q.factor_ic(factor_rows(spark, sf_dir))
    return d.select("snapshot", "metric", "pairs", rnd("ic").alias("ic"))


@query("factor_ic_summary", "AGG-11 PIP-5", compose(
    f"SELECT metric, {r('AVG(ic)')} AS mean_ic, {r('AVG(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END)')} AS share_positive, COUNT(*) AS snapshots FROM {_ic('SELECT * FROM longm', 'snapshot, metric')} GROUP BY 1",
    **_LOCAL, longm=_LONG))
def factor_ic_summary(spark, sf_dir):
    d = M.ic_summary(Q.factor_ic(factor_rows(spark, sf_dir)), ["metric"])
    return d.select("metric", rnd("mean_ic").alias("mean_ic"), rnd("share_positive").alias("share_positive"), "snapshots")


# ---- candidate signals -------------------------------------------------------------------------
_p = lambda a, b: X.pos(a, b)
_CAND_RAW = {
    "accruals": _p("c.net_income - c.ocf", "c.total_assets"), "gross_prof": _p("c.gross_profit", "c.total_assets"),
    "asset_growth": _p("c.total_assets - p.total_assets", "p.total_assets"), "net_issuance": _p("c.shares - p.shares", "p.shares"),
    "ocf_ni": _p("c.ocf", "c.net_income"), "interest_cov": _p("c.ebit", "c.interest_expense"), "capex_int": _p("ABS(c.capex)", "c.total_assets"),
    "roic": _p("c.ebit * (1e0 - CASE WHEN c.pretax_income > 0 AND c.income_tax / c.pretax_income BETWEEN 0 AND 0.5 THEN c.income_tax / c.pretax_income ELSE 0.21e0 END)", "c.equity + c.total_debt"),
    "sbc_rev": _p("c.stock_comp", "c.revenue"), "net_debt_ebitda": _p("c.total_debt - c.cash", "c.ebitda"), "fcf_ni": _p("c.fcf", "c.net_income"),
    "asset_turn": _p("c.revenue", "c.total_assets"),
}
_CAND_COLS = ", ".join(f"CASE WHEN ({e}) IS NOT NULL THEN {X.lin('(' + e + ')', *S.CANDIDATES[n])} END AS cand_{n}" for n, e in _CAND_RAW.items())
_FILED_LOCAL = {
    "seen_f": "SELECT g.ticker, g.snapshot, a.* EXCLUDE (ticker), ROW_NUMBER() OVER (PARTITION BY g.ticker, g.snapshot ORDER BY a.period_end DESC) AS k FROM snaprows g JOIN annual a ON a.ticker = g.ticker AND a.date_filed <= g.snapshot",
    "cands": f"SELECT c.ticker, c.snapshot, {_CAND_COLS} FROM (SELECT * FROM seen_f WHERE k = 1) c LEFT JOIN (SELECT * FROM seen_f WHERE k = 2) p ON p.ticker = c.ticker AND p.snapshot = c.snapshot",
    "wide_f": ("SELECT q.*, r6, r12, c.* EXCLUDE (ticker, snapshot) FROM quant_filed q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot "
               "JOIN cands c ON c.ticker = q.ticker AND c.snapshot = q.snapshot WHERE ni IS NOT NULL AND q.snapshot IN (SELECT snapshot FROM quant_filed WHERE ni IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 2)"),
    "long_f": " UNION ALL ".join(f"SELECT ticker, snapshot, '{n}' AS metric, cand_{n} AS x, r6 AS y FROM wide_f" for n in S.CANDIDATES),
}


@query("candidate_signals", "SCO-16 EXT-3", compose(
    "SELECT ticker, snapshot, " + ", ".join(f"{r('cand_' + n)} AS {n}" for n in S.CANDIDATES) + " FROM wide_f", **_FILED_LOCAL))
def candidate_signals(spark, sf_dir):
    d = Q.known_at_snapshot(stable(Q.with_health(features(spark, sf_dir, FILED)).select("ticker", "snapshot", "ni", "candidates")))
    return d.select("ticker", "snapshot", *[F.round(F.col("candidates")[n], 6).alias(n) for n in S.CANDIDATES])


@query("candidate_ic", "PIP-10 PIP-9 FLT-12 WIN-17", compose(
    f"SELECT snapshot, metric, pairs, {r('ic')} AS ic FROM {_ic('SELECT * FROM long_f', 'snapshot, metric')}", **_FILED_LOCAL))
def candidate_ic(spark, sf_dir):
    d = Q.candidate_ic(Q.known_at_snapshot(factor_rows(spark, sf_dir, FILED)))
    return d.select("snapshot", "metric", "pairs", rnd("ic").alias("ic"))


_TILT = Q.tilt_variants(list(S.CANDIDATES), [0.10])
_BASE = X.weighted(S.QUANT_WEIGHTS)


def _tilt_sql(v: dict) -> str:
    total = " + ".join(f"f_{f} * ({X.num(S.QUANT_WEIGHTS[f])} * (1e0 - {X.num(v['tilt'])}))" for f in S.QUANT_WEIGHTS)
    if v["tilt"]:
        total += f" + COALESCE(cand_{v['candidate']}, 50e0) * {X.num(v['tilt'])}"
    return f"SELECT '{v['name']}' AS variant, ticker, snapshot, CASE WHEN {X.DISQUALIFIED} THEN LEAST({total}, 50e0) ELSE {total} END AS total FROM wide_f"


def _cuts(source: str, group: str, ns: list[int]) -> str:
    return (f"SELECT x.*, b6, b12 FROM (SELECT {group}, CAST(n AS BIGINT) AS n, snapshot, AVG(r6) AS r6, AVG(r12) AS r12 FROM (SELECT q.*, r6, r12, ROW_NUMBER() OVER (PARTITION BY {group}, q.snapshot "
            f"ORDER BY total DESC, q.ticker) AS k FROM {source} q JOIN fwd ON fwd.ticker = q.ticker AND fwd.snapshot = q.snapshot), (SELECT UNNEST({ns}) AS n) WHERE k <= n GROUP BY 1, 2, 3) x LEFT JOIN bench ON bench.snapshot = x.snapshot")


@query("signal_tilt_sweep", "SCO-13 PIP-9 PIP-10 JOIN-19 EXT-3", compose(
    f"SELECT variant, n, snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql('cuts', 'variant, n')})",
    **_FILED_LOCAL, tilts=" UNION ALL ".join(_tilt_sql(v) for v in _TILT), cuts=_cuts("tilts", "variant", [5, 10])))
def signal_tilt_sweep(spark, sf_dir):
    """Ten percent of every candidate signal on top of the filing-date scores."""
    m = market(spark, sf_dir)
    rows = Q.known_at_snapshot(factor_rows(spark, sf_dir, FILED))
    d = E.variant_sweep(rows, E.benchmark_returns(m, E.dates_of(m, FILED)), _TILT, [5, 10])
    return d.select("variant", "n", "snapshots", "n6", "n12", *rounded(d, *_EM))


# ---- relative scores ---------------------------------------------------------------------------
_REL_RAW = {"pe": X.nonneg("trailing_pe"), "pb": X.nonneg("price_to_book"), "peg": X.nonneg("peg_ratio"), "fcf": X.FCFY, "eg": "earnings_growth",
            "rg": "revenue_growth", "roe": "return_on_equity", "roa": "return_on_assets", "mg": "profit_margin", "pvs": "price_vs_sma200",
            "r12": X.R12X1, "sl": "sma200_slope", "es": "eps_surprise"}


def _pct(n: str, e: str) -> str:
    base = (f"(ROW_NUMBER() OVER (PARTITION BY snapshot, ({e}) IS NULL ORDER BY ({e}) + 0e0, ticker) - 1) / CAST(COUNT(*) OVER (PARTITION BY snapshot, ({e}) IS NULL) - 1 AS DOUBLE) * 100e0")
    val = base if Q.RELATIVE_INPUTS[n] else f"100e0 - ({base})"
    return f"CASE WHEN ({e}) IS NULL OR COUNT({e}) OVER (PARTITION BY snapshot) < 2 THEN 50e0 ELSE {val} END AS p_{n}"


_REL = {
    "relp": f"SELECT *, {', '.join(_pct(n, e) for n, e in _REL_RAW.items())} FROM (SELECT * FROM classic_features WHERE ticker % 5 <> 0)",
    "relf": f"""SELECT *, {X.mix(('p_pe', .35), ('p_pb', .20), ('p_peg', .25), ('p_fcf', .20))} AS f_value, {X.mix(('p_eg', .55), ('p_rg', .45))} AS f_growth,
 {X.mix(('p_roe', .30), ('p_mg', .25), ('p_roa', .15), (X.IMPROVE, .30))} AS f_profitability, {X.mix((X.mix(('p_pvs', .35), ('p_r12', .40), ('p_sl', .25)), .70), (X.TECHNICAL, .30))} AS f_momentum,
 p_es AS f_eps_revisions, {X.QUANT['asset_growth']} AS f_asset_growth FROM relp""",
    "rel": f"SELECT ticker, snapshot, CASE WHEN {X.DISQUALIFIED} THEN LEAST({_BASE}, 50e0) ELSE {_BASE} END AS total FROM relf",
}


@query("relative_scores", "SCO-15 WIN-18", compose(f"SELECT ticker, snapshot, {r('total', 5)} AS total FROM rel", **_REL))
def relative_scores(spark, sf_dir):
    d = Q.relative_scores(stable(features(spark, sf_dir).drop("_visible")))
    return d.select("ticker", "snapshot", F.round("total", 5).alias("total"))


@query("relative_vs_absolute", "PIP-8", compose(
    f"SELECT variant, n, snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql('cuts', 'variant, n')})", **_REL,
    paired="SELECT 'relative' AS variant, ticker, snapshot, total FROM rel UNION ALL SELECT 'absolute', ticker, snapshot, total FROM quant_classic", cuts=_cuts("paired", "variant", [5, 10])))
def relative_vs_absolute(spark, sf_dir):
    m = market(spark, sf_dir)
    f = stable(features(spark, sf_dir).drop("_visible"))
    keep = ["ticker", "snapshot", "total", "r6", "r12"]
    s = (Q.relative_scores(f).select(F.lit("relative").alias("variant"), *keep)
         .unionByName(E.scored(f, CFG).select(F.lit("absolute").alias("variant"), *keep)))
    picks = R.top_n_many(s, ["variant", "snapshot"], [5, 10])
    rows = E.with_benchmark(M.basket_returns(picks, ["variant", "n", "snapshot"]), E.benchmark_returns(m, E.dates_of(m, CFG)))
    d = M.evaluation_metrics(rows, ["variant", "n"])
    return d.select("variant", "n", "snapshots", "n6", "n12", *rounded(d, *_EM))


@query("pool_comparison", "PIP-11 SET-4", compose(
    f"SELECT pool, n, snapshots, n6, n12, {_MCOLS} FROM ({X.metrics_sql('cuts', 'pool, n')})",
    pools="SELECT ticker, 'everything' AS pool FROM profiles UNION ALL SELECT ticker, 'consensus' FROM profiles WHERE ticker % 3 = 0 UNION ALL SELECT ticker, 'americas' FROM profiles WHERE region = 'AMERICA'",
    pooled="SELECT q.ticker, q.snapshot, q.total, pool FROM quant_classic q JOIN pools ON pools.ticker = q.ticker", cuts=_cuts("pooled", "pool", [5, 10])))
def pool_comparison(spark, sf_dir):
    m = market(spark, sf_dir)
    p = V.profiles(spark, sf_dir)
    flags = F.array_compact(F.array(F.lit("everything"), F.when(F.col("ticker") % 3 == 0, "consensus"), F.when(F.col("region") == "AMERICA", "americas")))
    bridge = p.select("ticker", F.explode(flags).alias("pool"))
    d = Q.pool_sweep(ranked(spark, sf_dir), bridge, E.benchmark_returns(m, E.dates_of(m, CFG)), [5, 10])
    return d.select("pool", "n", "snapshots", "n6", "n12", *rounded(d, *_EM))


# ---- source comparison -------------------------------------------------------------------------
_LASTSNAP = "(SELECT MAX(snapshot) FROM snaps)"
_A = f"SELECT ticker, total FROM quant_classic WHERE snapshot = {_LASTSNAP} AND ticker % 7 <> 3"
_B = f"SELECT ticker, total FROM quant_filed WHERE snapshot = {_LASTSNAP} AND ticker % 7 <> 4"
_CMP = {"sa": f"SELECT *, ROW_NUMBER() OVER (ORDER BY total DESC, ticker) AS k FROM ({_A})", "sb": f"SELECT *, ROW_NUMBER() OVER (ORDER BY total DESC, ticker) AS k FROM ({_B})",
        "cmp": "SELECT COALESCE(sa.ticker, sb.ticker) AS ticker, sa.total AS score_a, sb.total AS score_b, sa.k AS rank_a, sb.k AS rank_b, ABS(sa.total - sb.total) AS diff, "
               "CASE WHEN sa.ticker IS NOT NULL AND sb.ticker IS NOT NULL THEN 'common' WHEN sa.ticker IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side FROM sa FULL JOIN sb ON sa.ticker = sb.ticker"}


def _two_sources(spark, sf_dir):
    """The two feature paths at the last snapshot act as two data sources with partial overlap."""
    m = market(spark, sf_dir)
    at = stable(E.price_rows(m, CFG, E.dates_of(m, CFG).select(F.slice("dates", -1, 1).alias("dates"))))

    def last(cfg, missing):
        f = E.with_fundamentals(at, m, cfg).join(V.profiles(spark, sf_dir).filter("asset_type = 'STOCK'").select("ticker", "asset_type"), "ticker")
        return E.scored(f, cfg).filter(F.col("ticker") % 7 != missing)
    return last(CFG, 3), last(FILED, 4)


@query("compare_sources", "JOIN-13 SET-3", compose(f"SELECT ticker, side, {r('score_a', 5)} AS score_a, {r('score_b', 5)} AS score_b, rank_a, rank_b, {r('diff', 5)} AS diff FROM cmp", **_CMP))
def compare_sources(spark, sf_dir):
    d = Q.compare_scores(*_two_sources(spark, sf_dir))
    return d.select("ticker", "side", *rounded(d, "score_a", "score_b", "diff", digits=5), "rank_a", "rank_b")


@query("source_comparison_summary", "PIP-13 JOIN-13 SNK-6", compose(
    f"SELECT COUNT(CASE WHEN side = 'common' THEN 1 END) AS common_tickers, COUNT(CASE WHEN side = 'only_a' THEN 1 END) AS a_only, COUNT(CASE WHEN side = 'only_b' THEN 1 END) AS b_only, {r('AVG(diff)', 5)} AS avg_score_diff, {r('MAX(diff)', 5)} AS max_score_diff FROM cmp", **_CMP))
def source_comparison_summary(spark, sf_dir):
    d = Q.comparison_summary(Q.compare_scores(*_two_sources(spark, sf_dir)))
    return d.select("common_tickers", "a_only", "b_only", *rounded(d, "avg_score_diff", "max_score_diff", digits=5))


@query("largest_score_gaps", "TOP-6", compose(f"SELECT ticker, {r('diff', 5)} AS diff FROM cmp WHERE side = 'common' ORDER BY diff DESC, ticker LIMIT 10", **_CMP))
def largest_score_gaps(spark, sf_dir):
    d = Q.largest_diffs(Q.compare_scores(*_two_sources(spark, sf_dir)))
    return d.select("ticker", F.round("diff", 5).alias("diff"))


_FIELDS = ["trailing_pe", "price_to_book", "peg_ratio", "return_on_equity", "profit_margin", "earnings_growth", "debt_to_equity", "current_ratio", "dividend_yield", "eps_surprise"]
_FA = f"SELECT * FROM quant_classic WHERE snapshot = {_LASTSNAP} AND ticker % 7 <> 3"
_FB = f"SELECT * FROM quant_filed WHERE snapshot = {_LASTSNAP} AND ticker % 7 <> 4"


@query("field_coverage", "AGG-13", compose(" UNION ALL ".join(f"SELECT '{f}' AS field, {r(f'COUNT({f}) * 100e0 / COUNT(*)')} AS coverage FROM fa" for f in _FIELDS), fa=_FA))
def field_coverage(spark, sf_dir):
    d = Q.field_coverage(_two_sources(spark, sf_dir)[0], _FIELDS)
    return d.select("field", rnd("coverage").alias("coverage"))


_GAP = "CASE WHEN a.{f} IS NULL OR b.{f} IS NULL THEN 1e0 WHEN ABS(a.{f}) > 0.01 THEN ABS(a.{f} - b.{f}) / ABS(a.{f}) ELSE ABS(a.{f} - b.{f}) END"


@query("field_accuracy", "AGG-14", compose(
    f"SELECT field, {r('AVG(gap) * 100e0')} AS avg_rel_diff, {r('MAX(gap) * 100e0')} AS max_rel_diff, COUNT(CASE WHEN gap >= 1 THEN 1 END) AS missing_count FROM gaps GROUP BY 1", fa=_FA, fb=_FB,
    gaps=" UNION ALL ".join(f"SELECT '{f}' AS field, {_GAP.format(f=f)} AS gap FROM fa a JOIN fb b ON a.ticker = b.ticker WHERE a.{f} IS NOT NULL OR b.{f} IS NOT NULL" for f in _FIELDS)))
def field_accuracy(spark, sf_dir):
    d = Q.field_accuracy(*_two_sources(spark, sf_dir), _FIELDS)
    return d.select("field", rnd("avg_rel_diff").alias("avg_rel_diff"), rnd("max_rel_diff").alias("max_rel_diff"), "missing_count")
