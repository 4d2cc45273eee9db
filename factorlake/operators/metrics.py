"""Evaluation measures: baskets, chained returns, Sharpe, drawdown, IC summaries, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import RISK_FREE

PERIODS = 2  #: Fixed value: six-month returns, two per year.


def basket_returns(picks: DataFrame, group: list[str]) -> DataFrame:
    """Equal-weight mean of the known forward returns per group."""
    return picks.groupBy(*group).agg(F.avg("r6").alias("r6"), F.avg("r12").alias("r12"), F.count("*").alias("held"))


def sharpe(r: Column, per_year: int = PERIODS) -> Column:
    """Aggregate: annualised mean excess over sample deviation; 0 below two values or without spread."""
    n, sd = F.count(r), F.stddev_samp(r)
    value = F.try_divide(F.avg(r) - RISK_FREE / per_year, sd) * F.sqrt(F.lit(float(per_year)))
    return F.when((n >= 2) & (sd > 0), value).otherwise(0.0)


def equity_chain(df: DataFrame, group: list[str], order: str, r: str, out: str) -> DataFrame:
    """Running product of (1 + r); a NULL return leaves the value unchanged.

    ``product`` keeps a total loss exact where a sum of logarithms would fail.  A group has one row
    per snapshot or session of a single curve.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.product(F.coalesce(F.col(r), F.lit(0.0)) + 1.0).over(w))


def drawdowns(df: DataFrame, group: list[str], order: str, value: str, out: str, start: float | None = 1.0) -> DataFrame:
    """Relative distance to the running peak; with ``start`` the curve begins at that value."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(w)
    if start is not None:
        peak = F.greatest(peak, F.lit(float(start)))
    return df.withColumn(out, F.try_divide(F.col(value) - peak, peak))


def evaluation_metrics(snapshots: DataFrame, group: list[str], date: str = "snapshot") -> DataFrame:
    """One row per variant from rows (date, r6, r12, b6, b12).  Only rows with both r6 and b6 chain.

    Six-month returns of three-month snapshots overlap; they are chained as they are.  With a ``held``
    column the mean number of holdings comes along.
    """
    six = F.col("r6").isNotNull() & F.col("b6").isNotNull()
    twelve = F.col("r12").isNotNull() & F.col("b12").isNotNull()
    d = (snapshots.withColumn("_p", F.when(six, F.col("r6"))).withColumn("_q", F.when(six, F.col("b6"))))
    d = drawdowns(equity_chain(d, group, date, "_p", "_cum"), group, date, "_cum", "_dd")
    d = equity_chain(d, group, date, "_q", "_bench")
    n6, n12 = F.count("_p"), F.count(F.when(twelve, 1))
    wins6 = F.count_if(six & (F.col("r6") > F.col("b6")))
    wins12 = F.count_if(twelve & (F.col("r12") > F.col("b12")))
    cum, bench = F.max_by("_cum", date), F.max_by("_bench", date)
    years = F.greatest(n6 / 2.0, F.lit(1.0))
    held = [F.avg("held").alias("avg_holdings")] if "held" in snapshots.columns else []
    alpha = F.when(bench > 0, F.pow(F.try_divide(cum, bench), F.lit(1.0) / years) - 1.0).otherwise(0.0)
    return d.groupBy(*group).agg(
        F.count("*").alias("snapshots"), n6.alias("n6"), n12.alias("n12"),
        (cum - 1.0).alias("cumulative_return"), (bench - 1.0).alias("benchmark_return"),
        sharpe(F.col("_p")).alias("sharpe"), sharpe(F.col("_q")).alias("benchmark_sharpe"),
        (wins6 / F.greatest(n6, F.lit(1))).alias("win_rate_6m"), (wins12 / F.greatest(n12, F.lit(1))).alias("win_rate_12m"),
        F.abs(F.min("_dd")).alias("max_drawdown"), alpha.alias("alpha"), *held)


METRICS = ["cumulative_return", "benchmark_return", "sharpe", "benchmark_sharpe", "win_rate_6m",
           "win_rate_12m", "max_drawdown", "alpha"]


def ic_summary(ic: DataFrame, group: list[str]) -> DataFrame:
    return ic.groupBy(*group).agg(F.avg("ic").alias("mean_ic"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("share_positive"),
                                  F.count("*").alias("snapshots"))


def curve_metrics(curve: DataFrame, group: list[str], date: str = "session", value: str = "equity") -> DataFrame:
    """CAGR by calendar days, volatility, Sharpe without a risk-free rate, drawdown, Calmar, total."""
    w = Window.partitionBy(*group).orderBy(date)
    d = curve.filter(F.col(value).isNotNull()).withColumn("_r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1.0)
    d = drawdowns(d, group, date, value, "_dd", start=None)
    first, last = F.min_by(value, date), F.max_by(value, date)
    years = F.datediff(F.max(date), F.min(date)) / 365.25
    sd = F.stddev_samp("_r")
    out = d.groupBy(*group).agg(
        F.min(date).alias("start"), F.max(date).alias("end"),
        F.when(years > 0, F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years)) - 1.0).alias("cagr"),
        (sd * F.sqrt(F.lit(252.0))).alias("vol"),
        F.when(sd > 0, F.try_divide(F.avg("_r"), sd) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"), (F.try_divide(last, first) - 1.0).alias("total_return"))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.try_divide("cagr", F.abs("max_drawdown"))))


def hysteresis(ranked: DataFrame, group: list[str], bands: list[tuple[int, int, int]], reviews: DataFrame,
               date: str = "snapshot", key: str = "ticker") -> DataFrame:
    """Names held at every review: enter inside the top ``enter``, leave after ``confirm`` consecutive
    reviews outside the top ``exit``.

    ``ranked`` needs ``rank`` at least down to the largest exit band; ``reviews`` is one row with the
    array ``dates`` of all reviews.  State becomes three running maxima over a dense review grid, so
    there is no loop over dates and no Python: last time inside the exit band, last entry, last drop.
    """
    for enter, exit_, confirm in bands:
        if enter > exit_ or confirm < 1:
            raise ValueError("a band needs enter <= exit and confirm >= 1")
    widest = max(b[1] for b in bands)
    near = ranked.filter(F.col("rank") <= widest).groupBy(*group, key).agg(
        F.map_from_entries(F.collect_list(F.struct(date, "rank"))).alias("ranks"))
    band_list = F.array(*[F.struct(F.lit(e).alias("enter"), F.lit(x).alias("exit"), F.lit(k).alias("confirm")) for e, x, k in bands])
    grid = near.withColumn("band", F.explode(band_list)).select(
        *group, key, "ranks", "band.*", F.posexplode(reviews.scalar()).alias("seq", date))
    rank = F.try_element_at(F.col("ranks"), F.col(date))
    w = Window.partitionBy(*group, key, "enter", "exit", "confirm").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = (grid.withColumn("rank", rank)
         .withColumn("last_in", F.coalesce(F.max(F.when(F.col("rank") <= F.col("exit"), F.col("seq"))).over(w), F.lit(-1)))
         .withColumn("last_enter", F.max(F.when(F.col("rank") <= F.col("enter"), F.col("seq"))).over(w))
         .withColumn("last_drop", F.max(F.when(F.col("seq") - F.col("last_in") >= F.col("confirm"), F.col("seq"))).over(w)))
    held = F.col("last_enter").isNotNull() & (F.col("last_enter") > F.coalesce(F.col("last_drop"), F.lit(-1)))
    return d.filter(held).select(*group, "enter", "exit", "confirm", date, key)


def verdict(before: DataFrame, after: DataFrame, group: list[str]) -> DataFrame:
    """Metric deltas of two runs; all of alpha, Sharpe and 12-month wins up is IMPROVED, one of the first two MIXED."""
    a = before.select(*group, *[F.col(m).alias(f"{m}_before") for m in METRICS])
    d = after.join(a, group)
    up = lambda m: F.coalesce(F.col(m), F.lit(0.0)) > F.coalesce(F.col(f"{m}_before"), F.lit(0.0))
    word = (F.when(up("alpha") & up("sharpe") & up("win_rate_12m"), "IMPROVED")
            .when(up("alpha") | up("sharpe"), "MIXED").otherwise("REGRESSED"))
    return d.select(*group, *[(F.col(m) - F.col(f"{m}_before")).alias(f"delta_{m}") for m in METRICS], word.alias("verdict"))
