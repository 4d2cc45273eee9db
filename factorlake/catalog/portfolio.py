"""Macro regime and allocation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as AL, macro as MC, metrics as M
from ..plans import allocation as PA
from ..sources import driver_views as V
from .registry import query, rnd, rounded
from .sqlviews import compose, r

ROLES = {"vol": "signup", "ten": "click", "two": "view", "bond_vol": "error", "dollar": "purchase"}


@query("macro_by_session", "MAC-1 MAC-3 MAC-4 MAC-5 SRC-13 SRC-14 SRC-15", compose(
    """SELECT session, vol_regime, vol_action, ROUND(spread, 6) + 0.0 AS spread, score, CASE WHEN score >= 70 THEN 'healthy' WHEN score >= 45 THEN 'neutral' WHEN score >= 25 THEN 'warning' ELSE 'danger' END AS regime,
 CASE WHEN score >= 70 THEN 'buy' WHEN score >= 25 THEN 'hold' ELSE 'sell' END AS action, CASE WHEN score >= 70 THEN 'Technology,Financials,Consumer Cyclical,Communication Services' WHEN score >= 45 THEN 'Healthcare,Technology,Industrials'
 WHEN score >= 25 THEN 'Healthcare,Utilities,Consumer Staples,Energy' ELSE 'Utilities,Healthcare,Consumer Staples,Cash' END AS sectors FROM (
 SELECT *, CAST(GREATEST(0, LEAST(100, 50 + CASE vol_regime WHEN 'crash' THEN -10 WHEN 'bearish' THEN -5 WHEN 'bullish' THEN 10 ELSE 0 END + CASE WHEN spread < 0 THEN -10 WHEN spread < 0.5 THEN -5 WHEN spread > 1 THEN 10 ELSE 0 END
 + CASE WHEN bond > 120 THEN -10 WHEN bond > 100 THEN -5 WHEN bond < 60 THEN 10 ELSE 0 END + CASE WHEN usd > 105 THEN -10 WHEN usd > 100 THEN -5 WHEN usd < 95 THEN 10 ELSE 0 END
 + CASE WHEN mood < 25 THEN 10 WHEN mood < 45 THEN 5 WHEN mood > 75 THEN -10 WHEN mood > 55 THEN -5 ELSE 0 END + COALESCE(-SIGN(vt), 0) + COALESCE(-SIGN(bt), 0) + COALESCE(-SIGN(ut), 0))) AS INTEGER) AS score FROM (
 SELECT *, CASE WHEN v > 35 THEN 'crash' WHEN v > 25 THEN 'bearish' WHEN v > 15 THEN 'neutral' ELSE 'bullish' END AS vol_regime, CASE WHEN v > 35 THEN 'sell' WHEN v > 25 THEN 'hold' ELSE 'buy' END AS vol_action FROM (
 SELECT session, MAX(CASE WHEN symbol = 'signup' THEN close END) / 2e0 AS v, MAX(CASE WHEN symbol = 'error' THEN close END) * 2e0 AS bond, MAX(CASE WHEN symbol = 'purchase' THEN close END) * 2e0 AS usd, MAX(CASE WHEN symbol = 'signup' THEN close END) AS mood,
 CASE WHEN day(session) % 3 <> 0 THEN MAX(CASE WHEN symbol = 'click' THEN close END) / 10e0 - MAX(CASE WHEN symbol = 'view' THEN close END) / 10e0 ELSE MAX(CASE WHEN symbol = 'view' THEN close END) / 20e0 - MAX(CASE WHEN symbol = 'click' THEN close END) / 20e0 END AS spread,
 MAX(CASE WHEN symbol = 'signup' THEN t END) AS vt, MAX(CASE WHEN symbol = 'error' THEN t END) AS bt, MAX(CASE WHEN symbol = 'purchase' THEN t END) AS ut FROM (
 SELECT *, ROUND((close - LAG(close, 4) OVER w) / LAG(close, 4) OVER w * 100, 2) AS t FROM index_series WINDOW w AS (PARTITION BY symbol ORDER BY session)) GROUP BY 1)))"""))
def macro_by_session(spark, sf_dir):
    """Regime of every session; every third day lacks the index pair and falls back to the official curve."""
    d = MC.macro_table(V.index_series(spark, sf_dir), ROLES)
    pair = F.day("session") % 3 != 0
    spread = MC.yield_spread(F.when(pair, F.col("ten") / 10.0), F.when(pair, F.col("two") / 10.0), F.col("two") / 20.0, F.col("ten") / 20.0)
    v = F.col("vol") / 2.0
    score = MC.macro_score(v, spread, F.col("bond_vol") * 2.0, F.col("dollar") * 2.0, F.col("vol"), F.col("vol_trend"), F.col("bond_vol_trend"), F.col("dollar_trend"))
    d = d.withColumn("score", score).withColumn("vol_regime", MC.volatility_regime(v)).withColumn("regime", MC.macro_regime(F.col("score")))
    return d.select("session", "vol_regime", MC.regime_action(F.col("vol_regime")).alias("vol_action"), rnd(spread).alias("spread"), "score", "regime",
                    MC.macro_action(F.col("score")).alias("action"), F.array_join(MC.preferred_sectors(F.col("regime")), ",").alias("sectors"))


@query("filing_pulse", "AGG-17 SRC-18", compose(
    """SELECT c.kind, filings, symbols FROM (SELECT event_type AS kind, COUNT(*) AS filings FROM events WHERE ts <= TIMESTAMP '2024-01-31' AND ts > TIMESTAMP '2024-01-01' GROUP BY 1) c JOIN (
 SELECT kind, STRING_AGG(symbol, ',' ORDER BY k) AS symbols FROM (SELECT kind, symbol, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY at_ts DESC, symbol) AS k FROM (
 SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS symbol, MAX(ts) AS at_ts FROM events WHERE ts <= TIMESTAMP '2024-01-31' AND ts > TIMESTAMP '2024-01-01' GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1) s ON s.kind = c.kind"""))
def filing_pulse(spark, sf_dir):
    f = V.read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("symbol"))
    return MC.filing_pulse(f, F.lit("2024-01-31 00:00:00").cast("timestamp"))


# ---- allocation --------------------------------------------------------------------------------
INSTRUMENTS = 12


def panel(spark, sf_dir):
    """Twelve instruments over the whole trade table, dense by session."""
    t = V.daily(spark, sf_dir).withColumn("instrument", F.concat(F.lit("I"), (F.col("ticker") % INSTRUMENTS).cast("string")))
    bars = t.groupBy("instrument", "session").agg(F.sum("ext").alias("ext"), F.sum("qty").alias("qty"))
    d = PA.dense_panel(V._smoothed(bars, "instrument"), "instrument")
    return d.withColumn("sleeve", F.concat(F.lit("S"), (F.substring("instrument", 2, 3).cast("int") % 3).cast("string")))


_P = {
    "ibars": "SELECT 'I' || (ticker % 12) AS instrument, session, SUM(ext) AS ext, SUM(qty) AS qty FROM trades GROUP BY 1, 2",
    "isparse": "SELECT * FROM (SELECT instrument, session, ROW_NUMBER() OVER (PARTITION BY instrument ORDER BY session) AS k, CAST(SUM(ext) OVER f AS DOUBLE) / CAST(100 * SUM(qty) OVER f AS DOUBLE) AS close FROM ibars WINDOW f AS (PARTITION BY instrument ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE k >= 60",
    "panel": "SELECT * FROM (SELECT d.session, i.instrument, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY i.instrument ORDER BY d.session) AS close FROM (SELECT DISTINCT session FROM isparse) d CROSS JOIN (SELECT DISTINCT instrument FROM isparse) i LEFT JOIN isparse s ON s.session = d.session AND s.instrument = i.instrument) WHERE close IS NOT NULL",
    "pret": """SELECT *, CASE WHEN n >= 63 THEN STDDEV_SAMP(ret) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) * SQRT(252e0) END AS vol FROM (
 SELECT *, ROW_NUMBER() OVER w AS n, COALESCE(close / LAG(close) OVER w - 1, 0e0) AS ret, LEAD(session) OVER w AS nx, LAG(close, 21) OVER w AS past, LAG(close, 147) OVER w AS old6, LAG(close, 210) OVER w AS old9, LAG(close, 273) OVER w AS old12, 'S' || (CAST(instrument[2:] AS INTEGER) % 3) AS sleeve FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY session))""",
    "reb": """SELECT instrument, sleeve, session, n, vol, lookback, CASE WHEN lookback = 6 THEN n >= 149 AND COALESCE(past / old6 > 1, FALSE) ELSE n >= 275 AND COALESCE(past / old12 > 1, FALSE) END AS up FROM pret, (SELECT UNNEST([6, 12]) AS lookback)
 WHERE n >= 63 AND (nx IS NULL OR date_trunc('month', nx) <> date_trunc('month', session))""",
    "w_inv": "SELECT *, inv / SUM(inv) OVER (PARTITION BY lookback, session) AS w FROM (SELECT *, CASE WHEN up AND vol > 0 THEN 1e0 / vol END AS inv FROM reb)",
    "w_in": "SELECT *, inv / SUM(inv) OVER (PARTITION BY lookback, session, sleeve) AS w0 FROM (SELECT *, CASE WHEN up AND vol > 0 THEN 1e0 / vol END AS inv FROM reb)",
    "mixs": "SELECT a.lookback, a.session, a.sleeve, p.session AS day, SUM(a.w0 * p.ret) AS m FROM w_in a JOIN pret p ON p.instrument = a.instrument AND p.n BETWEEN a.n - 62 AND a.n WHERE a.w0 IS NOT NULL GROUP BY 1, 2, 3, 4",
    "sv": "SELECT lookback, session, sleeve, (1e0 / v) / SUM(1e0 / v) OVER (PARTITION BY lookback, session) AS share FROM (SELECT lookback, session, sleeve, STDDEV_SAMP(m) * SQRT(252e0) AS v FROM mixs GROUP BY 1, 2, 3)",
    "w_sl": "SELECT a.*, w0 * share AS w FROM w_in a LEFT JOIN sv ON sv.lookback = a.lookback AND sv.session = a.session AND sv.sleeve = a.sleeve",
}


def _capped_sql(source: str, targets: str) -> str:
    s = (f"SELECT a.lookback, a.session, a.instrument, vt, COALESCE(a.w, 0e0) * COALESCE(LEAST(vt / x.v, 1e0), 0e0) AS w FROM {source} a CROSS JOIN (SELECT UNNEST([{targets}]) AS vt) "
         f"LEFT JOIN (SELECT lookback, session, STDDEV_SAMP(m) * SQRT(252e0) AS v FROM (SELECT a.lookback, a.session, p.session AS day, SUM(a.w * p.ret) AS m FROM {source} a JOIN pret p ON p.instrument = a.instrument AND p.n BETWEEN a.n - 62 AND a.n WHERE a.w IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) x "
         "ON x.lookback = a.lookback AND x.session = a.session")
    for _ in range(AL.CAP_ROUNDS):
        s = (f"SELECT lookback, session, instrument, vt, CASE WHEN w >= 0.25e0 THEN 0.25e0 ELSE w + w * CASE WHEN ex > 0 AND room > 0 THEN ex / room ELSE 0e0 END END AS w FROM (SELECT *, SUM(GREATEST(w - 0.25e0, 0e0)) OVER g AS ex, "
             f"SUM(CASE WHEN w < 0.25e0 AND w > 0 THEN w ELSE 0e0 END) OVER g AS room FROM ({s}) WINDOW g AS (PARTITION BY lookback, session, vt))")
    return f"SELECT lookback, session, vt, instrument, CASE WHEN tot > 1 THEN w / tot ELSE w END AS weight FROM (SELECT *, SUM(w) OVER (PARTITION BY lookback, session, vt) AS tot FROM ({s}))"


def _target_sql(source: str) -> str:
    return f"SELECT CAST(lookback AS INTEGER) AS lookback, vt AS vol_target, session AS decided, instrument, {r('weight')} AS weight FROM ({_capped_sql(source, '0.08e0, 0.12e0')})"


def _targets(spark, sf_dir, sleeve):
    d = PA.grid_targets(panel(spark, sf_dir), "instrument", [6, 12], [0.08, 0.12], sleeve)
    return d.select("lookback", "vol_target", "decided", "instrument", rnd("weight").alias("weight"))


@query("inverse_vol_targets", "ALC-1 ALC-3 ALC-4 ALC-8 WIN-22 WIN-23 SRC-21", compose(_target_sql("w_inv"), **_P))
def inverse_vol_targets(spark, sf_dir):
    return _targets(spark, sf_dir, False)


@query("sleeve_risk_targets", "ALC-2 ALC-3 ALC-4 WIN-21", compose(_target_sql("w_sl"), **_P))
def sleeve_risk_targets(spark, sf_dir):
    return _targets(spark, sf_dir, True)


SPLITS = [("design", "1995-01-01", "1998-12-31"), ("test", "1999-01-01", "2001-12-31"), ("all", "1995-01-01", "2001-12-31")]
_CM = ["cagr", "vol", "sharpe", "max_drawdown", "total_return", "calmar"]

def _curve_sql(source: str, keys: str) -> str:
    """Metrics of the curves (keys, session, eq) in ``source``."""
    growth = "POW(l / f, 1e0 / (date_diff('day', d0, d1) / 365.25e0)) - 1"
    return (f"SELECT {keys}, {growth} AS cagr, sd * SQRT(252e0) AS vol, CASE WHEN sd > 0 THEN av / sd * SQRT(252e0) END AS sharpe, mdd AS max_drawdown, l / f - 1 AS total_return, CASE WHEN mdd < 0 THEN ({growth}) / ABS(mdd) END AS calmar FROM ("
            f"SELECT {keys}, MIN_BY(eq, session) AS f, MAX_BY(eq, session) AS l, MIN(session) AS d0, MAX(session) AS d1, STDDEV_SAMP(rr) AS sd, AVG(rr) AS av, MIN(dd) AS mdd FROM ("
            f"SELECT *, eq / LAG(eq) OVER w - 1 AS rr, eq / MAX(eq) OVER w - 1 AS dd FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY session)) GROUP BY ALL)")


@query("benchmark_curves", "ALC-7 AGG-15 FLT-15", compose(
    f"""SELECT curve, label, {", ".join(f"{r(c)} AS {c}" for c in _CM)} FROM ({_curve_sql("""(SELECT c.*, label FROM curves c JOIN (SELECT * FROM (VALUES ('design', DATE '1995-01-01', DATE '1998-12-31'), ('test', DATE '1999-01-01', DATE '2001-12-31'), ('all', DATE '1995-01-01', DATE '2001-12-31')) t(label, a, b)) ON session BETWEEN a AND b)""", "curve, label")})""", **_P,
    drets="SELECT session, 0.6e0 * COALESCE(MAX(CASE WHEN instrument = 'I1' THEN ret END), 0e0) + 0.4e0 * COALESCE(MAX(CASE WHEN instrument = 'I2' THEN ret END), 0e0) AS rm, SUM(ret) / (SELECT COUNT(DISTINCT instrument) FROM pret) AS re FROM pret GROUP BY 1",
    curves="SELECT 'mix' AS curve, session, PRODUCT(1 + rm) OVER (ORDER BY session) AS eq FROM drets UNION ALL SELECT 'equal', session, PRODUCT(1 + re) OVER (ORDER BY session) FROM drets"))
def benchmark_curves(spark, sf_dir):
    p = panel(spark, sf_dir)
    c = AL.benchmark_curve(p, {"I1": 0.6, "I2": 0.4}, "instrument").select("curve", "session", "equity").unionByName(
        AL.equal_weight_curve(p, "instrument").select("curve", "session", "equity"))
    d = M.curve_metrics(AL.split_labels(c, SPLITS), ["curve", "label"])
    return d.select("curve", "label", *rounded(d, *_CM))


# day by day, as money would move: yesterday's weights earn today's return and drift, what yesterday's close decided is then traded at ten basis points
def _walk_sql(keys: str, first: str, targets: str) -> str:
    """``first``: (keys, instrument, w) of the first session; ``targets``: (keys, session, instrument, weight)."""
    own = ", ".join(f"k.{k}" for k in keys.split(", "))
    same = " AND ".join(f"t.{k} = k.{k}" for k in keys.split(", "))
    return (f"SELECT {keys}, instrument, CAST(1 AS BIGINT) AS i, w, 1e0 AS eq, CAST(NULL AS DOUBLE) AS turn, CAST(NULL AS DOUBLE) AS invested FROM {first} UNION ALL "
            f"SELECT {keys}, instrument, i, nw, eq * (1 + port - COALESCE(turn, 0e0) * 0.001e0), turn, SUM(nw) OVER (PARTITION BY {keys}) FROM ("
            f"SELECT *, CASE WHEN trade THEN aim ELSE drift END AS nw, CASE WHEN trade THEN SUM(ABS(aim - drift)) OVER (PARTITION BY {keys}) END AS turn FROM ("
            f"SELECT *, w * (1 + ret) / (1 + port) AS drift FROM (SELECT {own}, k.instrument, k.i + 1 AS i, k.w, k.eq, COALESCE(p.ret, 0e0) AS ret, SUM(k.w * COALESCE(p.ret, 0e0)) OVER (PARTITION BY {own}) AS port, d.month_end AS trade, COALESCE(t.weight, 0e0) AS aim "
            f"FROM walk k JOIN wdays d ON d.i = k.i LEFT JOIN moves p ON p.i = k.i + 1 AND p.instrument = k.instrument LEFT JOIN {targets} t ON t.session = d.session AND t.instrument = k.instrument AND {same} WHERE d.nx IS NOT NULL)))")


def _walked_sql(keys: str, more: str) -> str:
    """Metrics, mean turnover and number of trades of the walked curves; ``more`` names further figures of ``walked``."""
    return (f"(SELECT c.*, s.* EXCLUDE ({keys}) FROM ({_curve_sql('walked', keys)}) c JOIN (SELECT {keys}, AVG(turn) AS avg_turnover, COUNT(turn) AS rebalances{more} FROM walked GROUP BY ALL) s USING ({keys}))")


_WALK = {
    "wdays": "SELECT *, nx IS NOT NULL AND date_trunc('month', nx) <> date_trunc('month', session) AS month_end FROM (SELECT session, ROW_NUMBER() OVER (ORDER BY session) AS i, LEAD(session) OVER (ORDER BY session) AS nx FROM (SELECT DISTINCT session FROM pret))",
    "moves": "SELECT d.i, instrument, ret FROM pret JOIN wdays d ON d.session = pret.session",
}
_GRID = {
    "grid_up": """SELECT instrument, session, n, vol, lookback, n >= (lookback + 1) * 21 + 2 AND COALESCE(past / CASE lookback WHEN 6 THEN old6 WHEN 9 THEN old9 ELSE old12 END > 1, FALSE) AS up FROM pret, (SELECT UNNEST([6, 9, 12]) AS lookback)
 WHERE nx IS NULL OR date_trunc('month', nx) <> date_trunc('month', session)""",
    "grid_w": "SELECT *, inv / SUM(inv) OVER (PARTITION BY lookback, session) AS w FROM (SELECT *, CASE WHEN up AND vol > 0 THEN 1e0 / vol END AS inv FROM grid_up)",
    "grid_aim": _capped_sql("grid_w", "0.08e0, 0.10e0, 0.12e0"),
    "walk": _walk_sql("lookback, vt", "(SELECT lookback, vt, instrument, 0e0 AS w FROM (SELECT UNNEST([6, 9, 12]) AS lookback), (SELECT UNNEST([0.08e0, 0.10e0, 0.12e0]) AS vt), (SELECT DISTINCT instrument FROM pret))", "grid_aim"),
    "walked": "SELECT lookback, vt, session, MAX(eq) AS eq, MAX(turn) AS turn, MAX(invested) AS invested FROM walk JOIN wdays USING (i) GROUP BY ALL",
}
_OVERLAY = {
    "overlay_aim": """SELECT rule, session, eq_off, UNNEST(['I1', 'I2']) AS instrument, UNNEST([CASE WHEN eq_off THEN 0e0 ELSE 0.6e0 END, CASE WHEN eq_off AND rule = 'rotate' THEN 1e0 ELSE 0.4e0 END]) AS weight FROM (
 SELECT rule, d.session, n > 274 AND NOT COALESCE(past / old12 - 1 > 0, FALSE) AS eq_off FROM wdays d LEFT JOIN (SELECT * FROM pret WHERE instrument = 'I1') p ON p.session = d.session, (SELECT UNNEST(['rotate', 'cash']) AS rule) WHERE month_end)""",
    "walk": _walk_sql("rule", "(SELECT rule, instrument, CASE instrument WHEN 'I1' THEN 0.6e0 ELSE 0.4e0 END AS w FROM (SELECT UNNEST(['rotate', 'cash']) AS rule), (SELECT UNNEST(['I1', 'I2']) AS instrument))", "overlay_aim"),
    "walked": "SELECT rule, session, MAX(eq) AS eq, MAX(turn) AS turn FROM walk JOIN wdays USING (i) GROUP BY ALL",
}


@query("allocation_grid", "ALC-5 ALC-8 AGG-15 AGG-20", compose(
    f"SELECT CAST(lookback AS INTEGER) AS lookback, vt AS vol_target, {', '.join(f'{r(c)} AS {c}' for c in [*_CM, 'avg_turnover', 'avg_exposure'])}, rebalances FROM {_walked_sql('lookback, vt', ', AVG(invested) AS avg_exposure')}", **_P, **_WALK, **_GRID))
def allocation_grid(spark, sf_dir):
    """Net curves of the parameter grid in closed form; the twin walks day by day."""
    from ..session import stable
    p = stable(panel(spark, sf_dir))
    t = stable(PA.grid_targets(p, "instrument", [6, 9, 12], [0.08, 0.10, 0.12], from_start=True))
    g = ["lookback", "vol_target"]
    curve = AL.equity_curve(p, t, g, "instrument")
    d = M.curve_metrics(curve, g).join(AL.turnover_exposure(curve, g), g)
    return d.select(*g, *rounded(d, *_CM, "avg_turnover", "avg_exposure"), "rebalances")


@query("trend_overlay", "ALC-6 AGG-20", compose(
    f"SELECT rule, {', '.join(f'{r(c)} AS {c}' for c in [*_CM, 'avg_turnover'])}, rebalances, (SELECT CAST(SUM(CAST(eq_off AS INTEGER)) AS BIGINT) FROM overlay_aim a WHERE a.rule = z.rule AND instrument = 'I1') AS months_off FROM {_walked_sql('rule', '')} z", **_P, **_WALK, **_OVERLAY))
def trend_overlay(spark, sf_dir):
    """60/40 with a trend rule on the first leg; rotated to the second leg or to cash. The last session decides nothing that is still traded."""
    from ..session import stable
    p = stable(panel(spark, sf_dir))
    t = None
    for name, rotate in (("rotate", True), ("cash", False)):
        x = AL.overlay_targets(p, "instrument", "I1", "I2", rotate).withColumn("rule", F.lit(name))
        t = x if t is None else t.unionByName(x)
    t = stable(t.filter(F.col("decided") < p.agg(F.max("session").alias("last")).scalar()))
    off = t.filter(F.col("instrument") == "I1").groupBy("rule").agg(F.sum("legs_off").alias("months_off"))
    curve = AL.equity_curve(p, t.select("rule", "decided", "instrument", "weight"), ["rule"], "instrument", {"I1": 0.6, "I2": 0.4})
    d = M.curve_metrics(curve, ["rule"]).join(AL.turnover_exposure(curve, ["rule"]), "rule").join(off, "rule")
    return d.select("rule", *rounded(d, *_CM, "avg_turnover"), "rebalances", "months_off")
