"""As-of and range joins.  Each names its clock: session, fiscal period end, or filing day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import months_to_days, snapshot_dates


def asof_close(dates: DataFrame, prices: DataFrame, key: str = "ticker", date: str = "snapshot") -> DataFrame:
    """Last non-NULL close at or before each date (the last one for dates past the series).

    Both sides are stacked and the newest close is carried forward, so there is one shuffle on the
    ticker and no pair is ever built.  On equal days the price sorts before the date that reads it.
    """
    left = dates.select(key, F.col(date).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("close"))
    right = (prices.filter(F.col("close").isNotNull())
             .select(key, F.col("session").alias("_at"), F.lit(0).alias("_side"), "close"))
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (left.unionByName(right)
            .withColumn("asof", F.last("close", ignorenulls=True).over(w))
            .filter(F.col("_side") == 1)
            .select(key, F.col("_at").alias(date), F.col("asof").alias("close")))


def period_array(facts: DataFrame, key: str = "ticker") -> DataFrame:
    """One row per ticker: its periods newest first (tens of rows per ticker, fiscal calendar bound)."""
    cols = [c for c in facts.columns if c not in (key, "period_end")]
    item = F.struct("period_end", *cols)
    return facts.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(item))).alias("periods"))


def ended_by(periods: Column, cutoff: Column) -> Column:
    """Periods that ended on or before the cutoff, newest first."""
    return F.filter(periods, lambda p: p["period_end"] <= cutoff)


def filed_by(periods: Column, cutoff: Column) -> Column:
    """Periods filed on or before the cutoff, newest period end first."""
    return F.filter(periods, lambda p: p["date_filed"] <= cutoff)


def n_back(periods: Column, n: int) -> Column:
    """The n-th older period, NULL when the series is shorter: the period is picked before the fact."""
    return F.get(periods, F.lit(n))


def latest_end(sessions: DataFrame) -> DataFrame:
    """One row: the newest session of all. As of that day every asset stands at its own last bar."""
    return sessions.agg(F.max("session").alias("latest"))


def latest_common_end(sessions: DataFrame, key: str = "ticker") -> DataFrame:
    """One row: the earliest of the last sessions."""
    return sessions.groupBy(key).agg(F.max("session").alias("s")).agg(F.min("s").alias("latest_common"))


def snapshot_array(sessions: DataFrame, lag_days: int = 60, years: float = 5, step_months: int = 3,
                   horizon_months: int = 12) -> DataFrame:
    """One row with the array of snapshot dates that leave room for the longest horizon."""
    end = F.date_sub("latest_common", lag_days)
    start = F.date_sub(end, int(365.25 * years))
    room = months_to_days(horizon_months)
    d = latest_common_end(sessions).withColumn("_d", snapshot_dates(end, start, step_months))
    return d.select(F.filter("_d", lambda x: F.date_add(x, room) <= F.col("latest_common")).alias("dates"))


def snapshot_grid(tickers: DataFrame, dates: DataFrame, key: str = "ticker") -> DataFrame:
    """Every ticker at every date: the date array is a scalar, so this is an explode, not a join."""
    return tickers.select(key, F.explode(dates.scalar()).alias("snapshot"))


def amounts_by_ticker(dividends: DataFrame, key: str = "ticker") -> DataFrame:
    """One row per ticker: its payments in currency (one per ex-date, calendar bound); decimals add up exactly in any order."""
    per_day = dividends.groupBy(key, "ex_date").agg(F.sum(F.col("amount").cast("decimal(28,10)")).cast("decimal(28,10)").alias("amount"))
    return per_day.groupBy(key).agg(F.collect_list(F.struct("ex_date", "amount")).alias("payments"))


def paid_between(payments: Column, start: Column, end: Column) -> Column:
    """Sum over ``[start, end)``; 0 when nothing was paid."""
    inside = F.filter(payments, lambda p: (p["ex_date"] >= start) & (p["ex_date"] < end))
    zero = F.lit(0).cast("decimal(28,10)")
    total = F.aggregate(inside, zero, lambda a, p: (a + F.coalesce(p["amount"].cast("decimal(28,10)"), zero)).cast("decimal(28,10)"))
    return F.coalesce(total.cast("double"), F.lit(0.0))


def reports_by_ticker(earnings: DataFrame, key: str = "ticker") -> DataFrame:
    """One row per ticker: valid earnings reports, one per day (latest stamp wins), newest first."""
    day = F.to_date("reported_at")
    valid = earnings.filter(F.col("eps_reported").isNotNull() & F.col("surprise_pct").isNotNull()
                            & ~F.isnan("surprise_pct") & (F.abs("surprise_pct") < F.lit(float("inf"))))
    per_day = (valid.groupBy(key, day.alias("day"))
               .agg(F.max_by("surprise_pct", "reported_at").alias("surprise"), F.max("reported_at").alias("stamp")))
    return per_day.groupBy(key).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("day", "stamp", "surprise")))).alias("reports"))


def mean_surprise(reports: Column, cutoff: Column, k: int = 4) -> Column:
    """Mean surprise of the newest ``k`` reports dated at or before the cutoff; NULL without any."""
    known = F.slice(F.filter(reports, lambda r: r["stamp"] <= cutoff), 1, k)
    total = F.aggregate(known, F.lit(0.0), lambda a, r: a + r["surprise"])
    return F.when(F.size(known) > 0, F.try_divide(total, F.size(known)))


def forward_return(start: Column, end: Column, bars: Column | None = None) -> Column:
    ret = F.when(start > 0, F.try_divide(end, start) - 1.0)
    return ret if bars is None else F.when(bars >= 2, ret)
