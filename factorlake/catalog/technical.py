"""Price features, as-of joins and calendar operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import dates as D, numeric as N
from ..operators import asof as A, metrics as M, ranking as R, scoring as S, technicals as T
from ..sources import driver_views as V
from .registry import query, rnd, rounded
from .sqlviews import MOMENTUM, compose, r


def _bars_query(name: str, covers: str, *cols: str):
    sql = compose("SELECT ticker, session, " + ", ".join(f"{r(c)} AS {c}" for c in cols) + " FROM tech")

    def run(spark, sf_dir):
        return T.bar_features(V.prices(spark, sf_dir)).select("ticker", "session", *[rnd(c).alias(c) for c in cols])
    query(name, covers, sql)(run)


_bars_query("bar_returns", "WIN-1 WIN-2 WIN-3 WIN-4 SRC-3", "daily_change", "return_1m", "return_3m", "return_6m", "return_12m")
_bars_query("bar_trend", "WIN-5 WIN-6", "price_vs_sma200", "sma200_slope")
_bars_query("bar_volatility", "WIN-7", "volatility_1y", "volatility_research")
_bars_query("bar_rsi_range", "WIN-8 WIN-10 WIN-11", "rsi_14", "week52_low", "week52_high", "pct_off_high")


@query("bar_macd", "WIN-9", compose(f"SELECT px.ticker, px.session, {r('macd_line')} AS macd_line, {r('macd_histogram')} AS macd_histogram "
                                    "FROM px JOIN macd m ON m.ticker = px.ticker AND m.n = px.n"))
def bar_macd(spark, sf_dir):
    return T.macd_bars(V.prices(spark, sf_dir)).select("ticker", "session", rnd("macd_line").alias("macd_line"),
                                                       rnd("macd_histogram").alias("macd_histogram"))


_AT = ("price", "daily_change", "return_1m", "return_12m", "price_vs_sma200", "sma200_slope", "volatility_1y", "rsi_14", "macd_line", "macd_histogram")


@query("technicals_at_snapshots", "FUN-10 WIN-9 JOIN-1 JOIN-5", compose(
    f"SELECT ticker, snapshot, session, {', '.join(f'{r(c)} AS {c}' for c in _AT)} FROM snaprows"))
def technicals_at_snapshots(spark, sf_dir):
    dates = A.snapshot_array(V.last_sessions(spark, sf_dir))
    d = T.features_at(V.prices(spark, sf_dir), dates)
    return d.select("ticker", "snapshot", "session", *rounded(d, *_AT))


@query("snapshot_calendar", "SCL-D3 FLT-11 AGG-10 SCL-D1 SCL-D2", compose(
    """SELECT snapshot, CAST(date_trunc('quarter', snapshot) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
 CAST(date_trunc('quarter', snapshot) - INTERVAL 1 DAY AS DATE) AS prev_quarter_end,
 CASE WHEN CAST(snapshot - 60 AS DATE) >= DATE '2000-01-01' THEN """ + __import__("factorlake.catalog.sqlviews", fromlist=["QUARTER"]).QUARTER
    + " END AS available_quarter FROM snaps"))
def snapshot_calendar(spark, sf_dir):
    d = A.snapshot_array(V.last_sessions(spark, sf_dir)).select(F.explode("dates").alias("snapshot"))
    return d.select("snapshot", D.quarter_end("snapshot").alias("quarter_end"), D.prev_quarter_end("snapshot").alias("prev_quarter_end"),
                    D.latest_available_quarter("snapshot").alias("available_quarter"))


@query("asof_close", "JOIN-1 JOIN-5", compose(
    """SELECT p.ticker, snapshot, ROUND((SELECT x.close FROM px x WHERE x.ticker = p.ticker AND x.session <= snapshot
 ORDER BY x.session DESC LIMIT 1), 6) AS close FROM (SELECT DISTINCT ticker FROM trades) p, snaps"""))
def asof_close(spark, sf_dir):
    grid = A.snapshot_grid(V.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker")),
                           A.snapshot_array(V.last_sessions(spark, sf_dir)))
    return A.asof_close(grid, V.prices(spark, sf_dir)).withColumn("close", rnd("close"))


@query("forward_returns", "WIN-13", compose(f"SELECT ticker, snapshot, {r('r6')} AS r6, {r('r12')} AS r12 FROM fwd"))
def forward_returns(spark, sf_dir):
    dates = A.snapshot_array(V.last_sessions(spark, sf_dir))
    h6, h12 = D.months_to_days(6), D.months_to_days(12)
    d = T.features_at(V.prices(spark, sf_dir), dates, (h6, h12))
    return d.select("ticker", "snapshot", rnd(A.forward_return(F.col("price"), F.col(f"close_{h6}"))).alias("r6"),
                    rnd(A.forward_return(F.col("price"), F.col(f"close_{h12}"))).alias("r12"))


@query("momentum_leaders", "SCO-5 WIN-12 FLT-2 TOP-1 WIN-14", compose(
    f"""SELECT ticker, session, {r('price')} AS price, {r('r12x1')} AS momentum_12_1, {r('score')} AS score FROM (
 SELECT *, {__import__('factorlake.catalog.sqlviews', fromlist=['R12X1']).R12X1} AS r12x1, {MOMENTUM} AS score FROM latest)
 WHERE price >= 1000 ORDER BY score DESC, ticker LIMIT 10"""))
def momentum_leaders(spark, sf_dir):
    """Ten assets with the best momentum at their last session (closes of at least 1000)."""
    w = Window.partitionBy("ticker").orderBy("session")
    d = (T.bar_features(V.prices(spark, sf_dir)).withColumn("_next", F.lead("session").over(w))
         .filter("_next IS NULL AND close >= 1000"))
    d = d.withColumn("score", S.quant_momentum()).withColumn("m", T.momentum_12_1(F.col("return_12m"), F.col("return_1m")))
    return (d.orderBy(F.col("score").desc(), "ticker").limit(10)
            .select("ticker", "session", rnd("close").alias("price"), rnd("m").alias("momentum_12_1"), rnd("score").alias("score")))


@query("latest_common_session", "AGG-10", compose("SELECT latest_common FROM common"))
def latest_common_session(spark, sf_dir):
    return A.latest_common_end(V.last_sessions(spark, sf_dir))


@query("rebalance_days", "WIN-22", compose(
    "SELECT session FROM (SELECT session, LEAD(session) OVER (ORDER BY session) AS nx FROM market) WHERE nx IS NULL OR date_trunc('month', nx) <> date_trunc('month', session)"))
def rebalance_days(spark, sf_dir):
    from ..operators.allocation import rebalance_flag
    d = rebalance_flag(V.market_prices(spark, sf_dir), ["symbol"])
    return d.filter("rebalance").select("session")


@query("trend_signal", "WIN-23", compose(
    """SELECT ticker, session, n >= 275 AND COALESCE(past / old - 1 > 0, FALSE) AS trending, n >= 275 AND COALESCE(past / old - 1 > 0 AND close > sma200, FALSE) AS trending_above_sma
 FROM (SELECT *, LAG(close, 21) OVER w AS past, LAG(close, 273) OVER w AS old FROM tech WINDOW w AS (PARTITION BY ticker ORDER BY session))"""))
def trend_signal(spark, sf_dir):
    from ..operators.allocation import trend_flag
    d = trend_flag(V.prices(spark, sf_dir), ["ticker"], lookback_m=12, skip_m=1)
    return d.select("ticker", "session", "trending", "trending_above_sma")


@query("percentile_of_last_close", "WIN-19 MAC-2", compose(
    """SELECT ticker, pct_rank, CASE WHEN pct_rank > 90 OR pct_rank < 15 THEN 'high' WHEN pct_rank < 30 THEN 'medium' ELSE 'low' END AS level FROM (
 SELECT ticker, ROUND(CAST(COUNT(CASE WHEN close < last THEN 1 END) AS DOUBLE) / COUNT(*) * 100, 1) AS pct_rank FROM (
 SELECT *, LAST_VALUE(close) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
 MAX(session) OVER (PARTITION BY ticker) AS last_day FROM px) WHERE session > CAST(last_day - 730 AS DATE) GROUP BY 1 HAVING COUNT(*) >= 20)"""))
def percentile_of_last_close(spark, sf_dir):
    from ..operators.macro import percentile_of_last, percentile_level
    d = percentile_of_last(V.prices(spark, sf_dir), "ticker", days=730)
    return d.select("ticker", "pct_rank", percentile_level(F.col("pct_rank")).alias("level"))


@query("five_session_trend", "WIN-20 SRC-13", compose(
    "SELECT symbol, session, ROUND((close - first) / first * 100, 2) + 0.0 AS trend_5d FROM (SELECT *, LAG(close, 4) OVER (PARTITION BY symbol ORDER BY session) AS first FROM index_series)"))
def five_session_trend(spark, sf_dir):
    from ..operators.macro import five_session_trend as trend
    return trend(V.index_series(spark, sf_dir)).select("symbol", "session", "trend_5d")


@query("equity_and_drawdown", "WIN-15 WIN-16", compose(
    f"""SELECT ticker, {r('MAX_BY(eq, n)')} AS equity, {r('ABS(MIN((eq - pk) / pk))')} AS max_drawdown FROM (
 SELECT *, GREATEST(1e0, MAX(eq) OVER (PARTITION BY ticker ORDER BY n)) AS pk FROM (
 SELECT ticker, n, PRODUCT(1 + COALESCE(ret, 0e0)) OVER (PARTITION BY ticker ORDER BY n) AS eq FROM px)) GROUP BY 1"""))
def equity_and_drawdown(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("session")
    d = V.prices(spark, sf_dir).withColumn("r", N.ratio("close", F.lag("close").over(w)) - 1.0)
    d = M.drawdowns(M.equity_chain(d, ["ticker"], "session", "r", "eq"), ["ticker"], "session", "eq", "dd")
    return d.groupBy("ticker").agg(F.round(F.max_by("eq", "session"), 6).alias("equity"), F.round(F.abs(F.min("dd")), 6).alias("max_drawdown"))


@query("average_return_rank", "WIN-17", compose(
    """SELECT ticker, snapshot, CAST(RANK() OVER (PARTITION BY snapshot ORDER BY v) + (COUNT(*) OVER (PARTITION BY snapshot, v) - 1) / 2e0 AS DOUBLE) AS avg_rank
 FROM (SELECT ticker, snapshot, ROUND(return_1m, 2) + 0.0 AS v FROM snaprows WHERE return_1m IS NOT NULL)"""))
def average_return_rank(spark, sf_dir):
    """Average-tie rank of the rounded one-month return inside every snapshot."""
    from ..session import stable
    dates = A.snapshot_array(V.last_sessions(spark, sf_dir))
    d = T.features_at(V.prices(spark, sf_dir), dates).select("ticker", "snapshot", F.round("return_1m", 2).alias("v"))
    return R.average_rank(stable(d), ["snapshot"], "v", "ticker", "avg_rank").select("ticker", "snapshot", "avg_rank")


@query("percentile_scores", "WIN-18", compose(
    f"""SELECT ticker, snapshot, {r('CAST(ROW_NUMBER() OVER (PARTITION BY snapshot ORDER BY v, ticker) - 1 AS DOUBLE) / (COUNT(*) OVER (PARTITION BY snapshot) - 1) * 100e0')} AS pct_score
 FROM (SELECT ticker, snapshot, ROUND(return_1m, 2) + 0.0 AS v FROM snaprows WHERE return_1m IS NOT NULL)"""))
def percentile_scores(spark, sf_dir):
    from ..session import stable
    dates = A.snapshot_array(V.last_sessions(spark, sf_dir))
    d = T.features_at(V.prices(spark, sf_dir), dates).select("ticker", "snapshot", F.round("return_1m", 2).alias("v"))
    return R.percentile_score(stable(d), ["snapshot"], "v", "ticker", "p").select("ticker", "snapshot", rnd("p").alias("pct_score"))


@query("final_sessions_only", "FLT-8 SCL-D5", compose(
    """SELECT ticker, MAX(session) AS session, COUNT(*) AS bars FROM px WHERE NOT (next IS NULL AND session >= DATE '2001-10-31') GROUP BY 1"""))
def final_sessions_only(spark, sf_dir):
    """Bars that are final at noon UTC of 2001-10-31: a last bar of that day or later is still open."""
    from ..operators.sessions import drop_partial_session
    d = drop_partial_session(V.prices(spark, sf_dir), F.lit("2001-10-31 12:00:00").cast("timestamp"))
    return d.groupBy("ticker").agg(F.max("session").alias("session"), F.count("*").alias("bars"))


@query("quote_session_repair", "JOIN-17 SCL-D4", compose(
    """SELECT ticker, MAX(session) AS session, COUNT(*) AS bars, ROUND(MAX_BY(close, session), 6) AS last_close FROM (
 SELECT ticker, session, close FROM px UNION ALL
 SELECT p.ticker, DATE '2001-11-02', 1000e0 + p.ticker FROM px p WHERE next IS NULL AND session < DATE '2001-11-02' AND p.ticker % 2 = 0) GROUP BY 1"""))
def quote_session_repair(spark, sf_dir):
    """Quotes of even assets carry the close of 2001-11-02; series that end earlier gain that bar."""
    from ..operators.sessions import reconcile_quote_session
    quotes = V.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ticker"), F.lit("1004734800").alias("quoted_at"),  # 2001-11-02 21:00 UTC
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(1000.0) + F.col("s_suppkey")).alias("regular_price"),
        F.lit(None).cast("double").alias("current_price"))
    d = reconcile_quote_session(V.prices(spark, sf_dir), quotes, F.lit("2001-11-05 00:00:00").cast("timestamp"))
    return d.groupBy("ticker").agg(F.max("session").alias("session"), F.count("*").alias("bars"), F.round(F.max_by("close", "session"), 6).alias("last_close"))
