"""Allocation rules as set operations over the long price panel.

A date's cross-section is the list of instruments of one strategy (dozens), a curve has one row per
session: both are bounded by design, so windows per (strategy, date) and per strategy are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio
from .metrics import equity_chain

# Fixed values of the study.
VOL_WINDOW = 63
TRADING_DAYS = 252
ASSET_CAP = 0.25
CAP_ROUNDS = 5
COST_BPS = 10.0
MONTH_BARS = 21
SPLIT_WEIGHTS = (0.6, 0.4)


def rebalance_flag(panel: DataFrame, keys: list[str]) -> DataFrame:
    """True on the last session of each month; the last row counts."""
    nxt = F.lead("session").over(Window.partitionBy(*keys).orderBy("session"))
    return panel.withColumn("rebalance", nxt.isNull() | (F.trunc(nxt, "MM") != F.trunc("session", "MM")))


def trend_flag(panel: DataFrame, keys: list[str], lookback_m: int = 12, skip_m: int = 1) -> DataFrame:
    """Price skip months back over the price skip + lookback months back is above one."""
    skip, back = skip_m * MONTH_BARS, (skip_m + lookback_m) * MONTH_BARS
    w = Window.partitionBy(*keys).orderBy("session")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = (panel.withColumn("bar", F.row_number().over(w)).withColumn("_cum", F.sum("close").over(so_far))
         .withColumn("sma200", F.when(F.col("bar") >= 200, (F.col("_cum") - F.coalesce(F.lag("_cum", 200).over(w), F.lit(0.0))) / 200.0))
         .withColumn("trend", ratio(F.lag("close", skip).over(w), F.lag("close", back).over(w)) - 1.0))
    up = (F.col("bar") >= back + 2) & F.coalesce(F.col("trend") > 0, F.lit(False))
    return (d.withColumn("trending", up)
            .withColumn("trending_above_sma", up & F.coalesce(F.col("close") > F.col("sma200"), F.lit(False))).drop("_cum"))


def trend_flags(panel: DataFrame, keys: list[str], lookbacks_m: list[int], skip_m: int = 1) -> DataFrame:
    """The trend flag for several lookbacks in one pass: one row per instrument, session and lookback."""
    w = Window.partitionBy(*keys).orderBy("session")
    d = panel.withColumn("bar", F.row_number().over(w)).withColumn("_past", F.lag("close", skip_m * MONTH_BARS).over(w))
    items = []
    for m in lookbacks_m:
        back = (skip_m + m) * MONTH_BARS
        old = F.lag("close", back).over(w)
        d = d.withColumn(f"_old{m}", old)
        up = (F.col("bar") >= back + 2) & F.coalesce(ratio(F.col("_past"), F.col(f"_old{m}")) > 1.0, F.lit(False))
        items.append(F.struct(F.lit(m).alias("lookback"), up.alias("trending")))
    d = d.withColumn("_l", F.explode(F.array(*items)))
    return d.select(*[c for c in panel.columns], "bar", F.col("_l.lookback").alias("lookback"), F.col("_l.trending").alias("trending"))


def with_returns(panel: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("session")
    last = w.rowsBetween(-(VOL_WINDOW - 1), 0)
    d = panel.withColumn("ret", F.coalesce(ratio("close", F.lag("close").over(w)) - 1.0, F.lit(0.0)))
    return d.withColumn("vol", F.stddev_samp("ret").over(last) * F.sqrt(F.lit(float(TRADING_DAYS)))).withColumn(
        "window_rets", F.collect_list("ret").over(last))


def _std_of_mix(members: Column) -> Column:
    """Annualised deviation of the fixed-weight mix of member return windows.

    w' Cov w equals the variance of the mixed return series, so no covariance matrix is formed.
    ``members``: array<struct<w, window_rets>> with windows of one common length.
    """
    size = F.size(F.get(members, F.lit(0))["window_rets"])
    mixed = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(
        members, F.lit(0.0), lambda acc, m: acc + m["w"] * F.get(m["window_rets"], i)))
    mean = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x) / size
    ss = F.aggregate(mixed, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(ss, size - 1) * TRADING_DAYS)


def inverse_vol(df: DataFrame, group: list[str], eligible: Column) -> DataFrame:
    """Adds ``w``: inverse volatility over the eligible instruments of the group, normalised."""
    ok = eligible & (F.col("vol") > 0)
    inv = F.when(ok, F.try_divide(F.lit(1.0), F.col("vol")))
    d = df.withColumn("_inv", inv)
    return d.withColumn("w", F.try_divide(F.col("_inv"), F.sum("_inv").over(Window.partitionBy(*group)))).drop("_inv")


def sleeve_budget(df: DataFrame, group: list[str], eligible: Column, sleeve: str = "sleeve") -> DataFrame:
    """Inverse volatility inside a sleeve, inverse sleeve volatility across sleeves."""
    inside = inverse_vol(df, [*group, sleeve], eligible)
    per_sleeve = (inside.filter(F.col("w").isNotNull()).groupBy(*group, sleeve)
                  .agg(_std_of_mix(F.collect_list(F.struct("w", "window_rets"))).alias("_sv")))
    across = per_sleeve.withColumn("_share", F.try_divide(F.try_divide(F.lit(1.0), F.col("_sv")),
                                   F.sum(F.try_divide(F.lit(1.0), F.col("_sv"))).over(Window.partitionBy(*group)))).drop("_sv")
    return inside.join(across, [*group, sleeve], "left").withColumn("w", F.col("w") * F.col("_share")).drop("_share")


def _once(c: Column) -> Column:
    """A one-element explode: the optimizer cannot copy the expression into every later use."""
    return F.explode(F.array(c))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def cap_weights(ws: Column) -> Column:
    """Asset cap on an array of weights: excess goes to the uncapped pro rata, at most five rounds."""
    def one_round(cur: Column, _: Column) -> Column:
        sums = F.aggregate(cur, F.struct(F.lit(0.0).alias("excess"), F.lit(0.0).alias("room")), lambda s, x: F.struct(
            (s["excess"] + F.greatest(x - ASSET_CAP, F.lit(0.0))).alias("excess"),
            (s["room"] + F.when((x < ASSET_CAP) & (x > 0), x).otherwise(0.0)).alias("room")))
        share = F.when((sums["excess"] > 0) & (sums["room"] > 0), F.try_divide(sums["excess"], sums["room"])).otherwise(0.0)
        return F.get(F.transform(F.array(share), lambda sh: F.transform(
            cur, lambda x: F.when(x >= ASSET_CAP, F.lit(ASSET_CAP)).otherwise(x + x * sh))), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(CAP_ROUNDS)), ws, one_round)


def target_weights(df: DataFrame, group: list[str], key: str, vol_target: Column | float, cash_allowed: bool = True) -> DataFrame:
    """Volatility target, cap and renormalisation over rows that carry ``w``.

    Output: group, ex_ante, key, weight (0 for instruments without one).
    """
    target = F.lit(vol_target) if isinstance(vol_target, float) else vol_target
    per = (df.groupBy(*group, target.alias("_target"))
           .agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce("w", F.lit(0.0)).alias("w"), "window_rets"))).alias("m")))
    per = per.withColumn("live", _once(F.filter("m", lambda x: x["w"] > 0)))
    d = per.withColumn("ex_ante", _once(F.when(F.size("live") > 0, _std_of_mix(F.col("live")))))
    room = F.least(F.try_divide(F.col("_target"), F.col("ex_ante")), F.lit(1.0)) if cash_allowed else F.lit(1.0)
    scaled = F.transform("m", lambda x: x["w"] * F.when(F.col("ex_ante") > 0, room).otherwise(0.0))
    d = d.withColumn("ws", _once(cap_weights(scaled))).withColumn("total", _once(_total(F.col("ws"))))
    names = F.transform("m", lambda x: x["k"])
    d = d.select(*group, "ex_ante", "total", F.explode(F.arrays_zip(names.alias("k"), F.col("ws").alias("ws"))).alias("z"))
    return d.select(*group, "ex_ante", F.col("z.k").alias(key),
                    F.when(F.col("total") > 1.0, F.try_divide("z.ws", "total")).otherwise(F.col("z.ws")).alias("weight"))


def equity_curve(panel: DataFrame, targets: DataFrame, group: list[str], key: str, start: dict[str, float] | None = None) -> DataFrame:
    """Net curve of a strategy: weights decided at a rebalance day trade after the next day's return.

    Inside a holding period the value relative to its first close is ``1 - sum w + sum w * P / P0``
    and the drifted weights follow from it, so no day-by-day loop is needed; costs are charged on the
    turnover between drifted and new weights on the first day after the rebalance.
    ``targets``: group, decided DATE, key, weight (one row per instrument, zero weights included).
    ``start``: weights held from the first session on, without a cost; else all is cash until the first trade.
    The curve has every session of the panel and begins at one; ``exposure`` is the invested share at the
    close, unknown on the first session. An instrument has the return zero until its first close.
    """
    order = Window.orderBy("session")  # one row per calendar session
    calendar = panel.select("session").distinct().withColumn("next_session", F.lead("session").over(order))
    days = calendar.agg(F.array_sort(F.collect_list("session")).alias("days"))
    groups = targets.select(*group).distinct()
    # the period of a decision starts at the close of the trading day after it
    decided = targets.select(*group, "decided").distinct().join(
        calendar.select(F.col("session").alias("decided"), F.col("next_session").alias("traded")), "decided").filter("traded IS NOT NULL")
    trades = targets.join(decided, [*group, "decided"]).select(*group, "traded", key, "weight")
    held, marks = trades, decided.select(*group, "traded")
    if start:
        legs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in start.items()])
        first = groups.withColumn("traded", F.get(days.scalar(), F.lit(0)))
        held = held.unionByName(first.withColumn("_l", F.explode(legs)).select(*group, "traded", F.col("_l.k").alias(key), F.col("_l.v").alias("weight")))
        marks = marks.unionByName(first)
    # every session belongs to the last trade strictly before it: a carry-forward per curve, no range join
    before = Window.partitionBy(*group).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    grid = (groups.withColumn("session", F.explode(days.scalar()))
            .join(marks.select(*group, F.col("traded").alias("session"), F.col("traded").alias("mark")), [*group, "session"], "left")
            .withColumn("traded", F.last("mark", ignorenulls=True).over(before))
            .withColumn("ends", F.col("mark").isNotNull()).drop("mark"))
    own = panel.groupBy(key).agg(F.min("session").alias("_s0"), F.min_by("close", "session").alias("close"))
    early = own.withColumn("session", F.explode(days.scalar())).filter(F.col("session") < F.col("_s0")).select(key, "session", "close")
    px = panel.select(key, "session", "close").unionByName(early)
    p0 = px.select(key, F.col("session").alias("traded"), F.col("close").alias("p0"))
    inside = held.join(p0, [key, "traded"]).join(grid.filter("traded IS NOT NULL"), [*group, "traded"]).join(px, [key, "session"])
    now = F.sum(F.col("weight") * ratio("close", "p0"))
    value = inside.groupBy(*group, "traded", "session", "ends").agg((F.lit(1.0) - F.sum("weight") + now).alias("v"), now.alias("invested"))
    # drifted weights at the trade that ends the period
    end = inside.filter("ends").join(value.filter("ends").select(*group, "traded", "v"), [*group, "traded"])
    drifted = end.select(*group, F.col("session").alias("traded"), key, ratio(F.col("weight") * ratio("close", "p0"), "v").alias("drifted"))
    turnover = (trades.join(drifted, [*group, "traded", key], "left")
                .groupBy(*group, F.col("traded").alias("session"))
                .agg(F.sum(F.abs(F.col("weight") - F.coalesce("drifted", F.lit(0.0)))).alias("turnover"), F.sum("weight").alias("placed")))
    # the value at the trade itself is one
    w = Window.partitionBy(*group, "traded").orderBy("session")
    daily = value.select(*group, "session", (ratio("v", F.coalesce(F.lag("v").over(w), F.lit(1.0))) - 1.0).alias("r"), ratio("invested", "v").alias("kept"))
    first_day = F.col("session") == F.get(days.scalar(), F.lit(0))
    net = (grid.select(*group, "session").join(daily, [*group, "session"], "left").join(turnover, [*group, "session"], "left")
           .withColumn("net", F.coalesce("r", F.lit(0.0)) - F.coalesce(F.col("turnover") * (COST_BPS / 10000.0), F.lit(0.0)))
           .withColumn("exposure", F.when(~first_day, F.coalesce("placed", "kept", F.lit(0.0)))))
    return equity_chain(net.drop("r", "kept", "placed"), group, "session", "net", "equity")


def benchmark_curve(panel: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """Daily rebalanced fixed mix."""
    d = with_plain_returns(panel, key)
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    per_day = d.groupBy("session").agg(F.sum(F.col("ret") * F.coalesce(F.try_element_at(table, F.col(key)), F.lit(0.0))).alias("ret"))
    return equity_chain(per_day.withColumn("curve", F.lit("mix")), ["curve"], "session", "ret", "equity")


def equal_weight_curve(panel: DataFrame, key: str) -> DataFrame:
    """Daily rebalanced equal shares of all instruments; one without a close yet returns zero."""
    names = panel.agg(F.countDistinct(key).alias("names"))
    per_day = with_plain_returns(panel, key).groupBy("session").agg((F.sum("ret") / names.scalar()).alias("ret"))
    return equity_chain(per_day.withColumn("curve", F.lit("equal")), ["curve"], "session", "ret", "equity")


def scaled_curve(curve: DataFrame, factor: float) -> DataFrame:
    """The same daily returns times a constant."""
    w = Window.partitionBy("curve").orderBy("session")
    d = curve.withColumn("ret", F.coalesce(ratio("equity", F.lag("equity").over(w)) - 1.0, F.lit(0.0)) * factor)
    return equity_chain(d, ["curve"], "session", "ret", "equity")


def with_plain_returns(panel: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("session")
    return panel.withColumn("ret", F.coalesce(ratio("close", F.lag("close").over(w)) - 1.0, F.lit(0.0)))


def overlay_targets(panel: DataFrame, key: str, equity: str, bond: str, rotate: bool = True, filter_bond: bool = False) -> DataFrame:
    """60/40 with a 12-1 trend rule on the equity leg (and on the bond leg when asked), at every month end of the panel."""
    ends = rebalance_flag(panel.select("session").distinct(), []).filter("rebalance").select(F.col("session").alias("decided"))
    d = rebalance_flag(trend_flag(panel.filter(F.col(key).isin(equity, bond)), [key]), [key])
    off = (F.col("bar") > 274) & ~F.coalesce(F.col("trend") > 0, F.lit(False))
    per = d.filter("rebalance").groupBy(F.col("session").alias("decided")).agg(
        F.max(F.when((F.col(key) == equity), off)).alias("eq_off"), F.max(F.when((F.col(key) == bond), off)).alias("bd_off"))
    per = ends.join(per, "decided", "left")  # a leg without a close yet is not off
    base_eq, base_bd = SPLIT_WEIGHTS
    bd_out = F.col("bd_off") if filter_bond else F.lit(False)
    w_eq = F.when(F.col("eq_off"), 0.0).otherwise(base_eq)
    w_bd = F.when(bd_out, 0.0)
    if rotate and not filter_bond:
        w_bd = w_bd.when(F.col("eq_off"), base_bd + base_eq)
    w_bd = w_bd.otherwise(base_bd)
    both = F.array(F.struct(F.lit(equity).alias(key), w_eq.alias("weight")), F.struct(F.lit(bond).alias(key), w_bd.alias("weight")))
    out = per.withColumn("_b", F.explode(both))
    return out.select("decided", F.col(f"_b.{key}").alias(key), F.col("_b.weight").alias("weight"),
                      F.col("eq_off"), (F.col("eq_off").cast("int") + (bd_out & F.lit(filter_bond)).cast("int")).alias("legs_off"))


def turnover_exposure(curve: DataFrame, group: list[str]) -> DataFrame:
    """Mean turnover per rebalance, number of rebalances, mean share invested."""
    return curve.groupBy(*group).agg(F.avg("turnover").alias("avg_turnover"), F.count("turnover").alias("rebalances"),
                                     F.avg("exposure").alias("avg_exposure"))


def split_labels(curve: DataFrame, splits: list[tuple[str, str, str]]) -> DataFrame:
    """Copies each session into every labelled slice that contains it (inclusive bounds)."""
    items = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in splits])
    d = curve.withColumn("_s", F.explode(items)).filter(F.col("session").between(F.col("_s.a"), F.col("_s.b")))
    return d.withColumn("label", F.col("_s.label")).drop("_s")


def long_enough(panel: DataFrame, key: str, min_bars: int = 500) -> DataFrame:
    """Drops instruments with at most ``min_bars`` known closes."""
    counts = panel.groupBy(key).agg(F.count("close").alias("_n")).filter(F.col("_n") > min_bars).select(key)
    return panel.join(counts, key, "left_semi")
