"""Allocation study: dense panel -> rebalance targets for a parameter grid -> curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import allocation as AL


def dense_panel(panel: DataFrame, key: str) -> DataFrame:
    """Every instrument on every session, gaps filled forward; rows before the first close drop out.

    Instruments are the dozens of one study, so their list is a scalar array and the grid an explode.
    """
    names = panel.agg(F.array_sort(F.collect_set(key)).alias("names"))
    grid = panel.select("session").distinct().select("session", F.explode(names.scalar()).alias(key))
    w = Window.partitionBy(key).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    d = grid.join(panel.select("session", key, "close"), ["session", key], "left")
    return d.withColumn("close", F.last("close", ignorenulls=True).over(w)).filter("close IS NOT NULL")


def grid_targets(panel: DataFrame, key: str, lookbacks_m: list[int], vol_targets: list[float], sleeve: bool = False,
                 cash_allowed: bool = True, from_start: bool = False) -> DataFrame:
    """Weights at every month end for lookback x volatility target: (lookback, vol_target, decided, key, weight).

    ``from_start`` also gives the month ends before an instrument has a full volatility window (weight zero).
    """
    keys = [key, "sleeve"] if sleeve else [key]
    d = AL.rebalance_flag(AL.with_returns(panel, [key]), [key])
    d = AL.trend_flags(d, keys, lookbacks_m).filter(F.col("rebalance") & (F.lit(from_start) | (F.size("window_rets") == AL.VOL_WINDOW)))
    group = ["lookback", "session"]
    weigh = AL.sleeve_budget if sleeve else AL.inverse_vol
    d = weigh(d, group, F.col("trending"))
    d = d.withColumn("vol_target", F.explode(F.array(*[F.lit(v) for v in vol_targets])))
    t = AL.target_weights(d, ["lookback", "vol_target", "session"], key, F.col("vol_target"), cash_allowed)
    return t.withColumnRenamed("session", "decided")
