"""Price features.  One partitioning and one sort by (ticker, session) serve all of them.

A ticker has at most one bar per calendar day, so a window partition holds thousands of rows, never
an unbounded group.  Long averages use running sums (constant work per bar) instead of re-reading
200 or 251 bars for every row, the 252-bar extremes are put together from extremes of 6 and 42 bars;
only the 14-bar averages and the 6-bar extremes use a sliding frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import finite, sharpe_proxy

#: Bars per trading year and the indicator spans.
TRADING_DAYS = 252
SMA_BARS = 200
SLOPE_BARS = 125
RSI_BARS = 14
MIN_INDICATOR_BARS = 35
EMA_FAST, EMA_SLOW, EMA_SIGNAL = 12, 26, 9
#: Bars per block of the exponential averages.  What a block inherits from before its predecessor is
#: below 1e-34 of its value, so carrying one block back is exact in double precision, and the weights
#: inside a block stay below 1e100 however long the series is.
EMA_BLOCK = 1024
#: Bars of the short extremes, how many of them make a longer one, and how many of those a trading year.
EXTREME_STEPS = (6, 7, 6)


def _over_past(close: Column, past: Column) -> Column:
    return F.when(past > 0, F.try_divide(close, past) - 1.0)


def numbered(prices: DataFrame, key: str) -> DataFrame:
    """Known closes with their bar number ``n`` and its place (``block``, ``pos``) for the averages."""
    d = prices.withColumn("close", finite("close")).filter(F.col("close").isNotNull())
    d = d.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("session")))
    return d.withColumns({"block": F.floor((F.col("n") - 1) / EMA_BLOCK).cast("int"), "pos": ((F.col("n") - 1) % EMA_BLOCK).cast("int")})


def bar_features(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """Every price feature at every bar; columns nobody reads are pruned with their windows."""
    return _finished(_windowed(prices, key), [key, "session", "close", "n"])


def _windowed(prices: DataFrame, key: str, with_averages: bool = False) -> DataFrame:
    """The window values behind the features.  ``with_averages`` adds the MACD columns and the next session; then all windows share the order
    (block, n) that the averages need, so the narrow rows are sorted once more and wide ones never.
    """
    w = Window.partitionBy(key).orderBy("block", "n") if with_averages else Window.partitionBy(key).orderBy("session")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    close = F.col("close")
    d = numbered(prices, key)
    if with_averages:
        d = with_macd(d, key).withColumn("next", F.lead("session").over(w))
    few, some, many = EXTREME_STEPS
    extremes = {"low": (F.min, F.least), "high": (F.max, F.greatest)}

    def joined(pick: Callable[..., Column], c: str, step: int, times: int) -> Column:
        """The extreme over ``times`` spans of ``step`` bars that end one after the other, missing ones left out."""
        return pick(F.col(c), *[F.lag(c, step * i).over(w) for i in range(1, times)])
    last_few = w.rowsBetween(-(few - 1), 0)
    d = (d.withColumns({"prev": F.lag("close", 1).over(w), "base": F.first("close").over(so_far),
                        **{f"_{c}_few": best("close").over(last_few) for c, (best, _) in extremes.items()}})
         .withColumns({"ret": _over_past(close, F.col("prev")), "gain": F.greatest(close - F.col("prev"), F.lit(0.0)),
                       "loss": F.greatest(F.col("prev") - close, F.lit(0.0))}))
    last14 = w.rowsBetween(-(RSI_BARS - 1), 0)
    d = d.withColumns({
        "cum": F.sum(close - F.col("base")).over(so_far),
        "ret1": F.coalesce(F.sum("ret").over(so_far), F.lit(0.0)),
        "ret2": F.coalesce(F.sum(F.col("ret") * F.col("ret")).over(so_far), F.lit(0.0)),
        "rets": F.count("ret").over(so_far),
        "avg_gain": F.avg("gain").over(last14), "avg_loss": F.avg("loss").over(last14),
        **{f"_{c}_some": joined(pick, f"_{c}_few", few, some) for c, (_, pick) in extremes.items()}})
    back = TRADING_DAYS - 1
    s1 = F.col("ret1") - F.coalesce(F.lag("ret1", back).over(w), F.lit(0.0))
    s2 = F.col("ret2") - F.coalesce(F.lag("ret2", back).over(w), F.lit(0.0))
    m = F.col("rets") - F.coalesce(F.lag("rets", back).over(w), F.lit(0))
    d = d.withColumns({
        "sma200": F.when(F.col("n") >= SMA_BARS,
                         F.col("base") + (F.col("cum") - F.coalesce(F.lag("cum", SMA_BARS).over(w), F.lit(0.0))) / SMA_BARS),
        "_m": m, "_s1": s1, "_s2": s2,
        "past_1m": F.lag("close", 21).over(w), "past_3m": F.lag("close", 63).over(w),
        "past_6m": F.lag("close", 126).over(w), "past_12m": F.lag("close", back).over(w),
        **{f"{c}_252": joined(pick, f"_{c}_some", few * some, many) for c, (_, pick) in extremes.items()}})
    square = F.greatest(F.lit(0.0), F.try_divide(F.col("_s2") - F.try_divide(F.col("_s1") * F.col("_s1"), F.col("_m")), F.col("_m") - 1))
    d = d.withColumn("_std", F.when(F.col("_m") > 1, F.sqrt(square)))
    return d.withColumn("sma_back", F.lag("sma200", SLOPE_BARS).over(w))


def _finished(d: DataFrame, keep: list[str]) -> DataFrame:
    """Guarded ratios over the window values."""
    close, sma_back = F.col("close"), F.col("sma_back")
    rs = F.try_divide(F.col("avg_gain"), F.col("avg_loss"))
    rsi = F.when(F.col("avg_loss") == 0, 100.0).otherwise(F.lit(100.0) - F.lit(100.0) / (rs + 1.0))
    annual_vol = F.col("_std") * F.sqrt(F.lit(float(TRADING_DAYS)))
    return d.select(
        *keep,
        F.when(F.col("prev") > 0, F.try_divide(close, F.col("prev")) - 1.0).alias("daily_change"),
        _over_past(close, F.col("past_1m")).alias("return_1m"),
        _over_past(close, F.col("past_3m")).alias("return_3m"),
        _over_past(close, F.col("past_6m")).alias("return_6m"),
        _over_past(close, F.col("past_12m")).alias("return_12m"),
        "sma200",
        _over_past(close, F.col("sma200")).alias("price_vs_sma200"),
        _over_past(F.col("sma200"), sma_back).alias("sma200_slope"),
        F.when((F.col("n") >= TRADING_DAYS) & (F.col("_m") > 30), annual_vol).alias("volatility_1y"),
        F.when((F.col("n") >= 60) & (F.col("_m") >= 30), annual_vol).alias("volatility_research"),
        F.when(F.col("n") >= MIN_INDICATOR_BARS, rsi).alias("rsi_14"),
        F.when(F.col("n") >= 2, F.col("low_252")).alias("week52_low"),
        F.when(F.col("n") >= 2, F.col("high_252")).alias("week52_high"),
        F.when(F.col("n") >= 2, _over_past(close, F.col("high_252"))).alias("pct_off_high"),
    )


#: Features carried from a bar to the snapshot it answers for.
FEATURES = ["daily_change", "return_1m", "return_3m", "return_6m", "return_12m", "price_vs_sma200",
            "sma200_slope", "volatility_1y", "volatility_research", "rsi_14", "week52_low", "week52_high", "pct_off_high",
            "macd_line", "macd_histogram"]


def _ema(d: DataFrame, key: str, values: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds exponential averages seeded with the first value: out -> (input column, span).

    Needs ``n``, ``block`` and ``pos``.  A recursive average is a weighted running sum: inside a block
    the weights are rescaled to its first bar, the end of the previous block is carried over.
    """
    order = Window.partitionBy(key).orderBy("block", "n")
    inside = Window.partitionBy(key, "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    local, full = {}, {}
    for out, (value, span) in values.items():
        a = 2.0 / (span + 1)
        keep = 1.0 - a
        weight = F.when(F.col("n") == 1, 1.0).otherwise(a) * F.pow(F.lit(1.0 / keep), F.col("pos"))
        local[out] = F.pow(F.lit(keep), F.col("pos")) * F.sum(F.col(value) * weight).over(inside)
    d = d.withColumns(local)
    for out, (_, span) in values.items():
        keep = 1.0 - 2.0 / (span + 1)
        end = F.when(F.col("pos") == EMA_BLOCK - 1, F.col(out))
        carry = F.last(end, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        full[out] = F.col(out) + F.pow(F.lit(keep), F.col("pos") + 1) * F.coalesce(carry, F.lit(0.0))
    return d.withColumns(full)


def with_macd(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Adds macd_line and macd_histogram (fractions of the close) to ``numbered`` bars."""
    d = _ema(bars, key, {"_fast": ("close", EMA_FAST), "_slow": ("close", EMA_SLOW)})
    d = _ema(d.withColumn("_line", F.col("_fast") - F.col("_slow")), key, {"_sig": ("_line", EMA_SIGNAL)})
    ok = (F.col("n") >= MIN_INDICATOR_BARS) & (F.col("close") > 0)
    return d.select(*bars.columns, F.when(ok, F.try_divide("_line", "close")).alias("macd_line"),
                    F.when(ok, F.try_divide(F.col("_line") - F.col("_sig"), F.col("close"))).alias("macd_histogram"))


def _asked(dates: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row, one struct: the dates to answer in order, each with its snapshot and horizon, the first of
    them, and for every day of the calendar from there on how many lie on or before it."""
    def answers(h: int) -> Column:
        return F.transform("dates", lambda x: F.struct(F.date_add(x, h).alias("at"), x.alias("snapshot"), F.lit(h).alias("h")))
    each = [answers(h) for h in (0, *horizons)]
    d = dates.select(F.array_sort(F.flatten(F.array(*each))).alias("asked"))
    first, last = F.get("asked", F.lit(0))["at"], F.get("asked", F.size("asked") - 1)["at"]
    counts = F.transform(F.sequence(F.lit(0), F.datediff(last, first)), lambda i: F.size(F.filter("asked", lambda a: F.datediff(a["at"], first) <= i)))
    return d.select(F.struct("asked", first.alias("first"), counts.alias("counts")))


def features_at(prices: DataFrame, dates: DataFrame, horizons: tuple[int, ...] = (),
                key: str = "ticker") -> DataFrame:
    """Features as of every snapshot date: (ticker, snapshot, session, price, features, close_<days>).

    ``dates`` is one row with one array of dates.  A bar answers for the dates in
    ``[its session, next session)``, the last bar for everything later, so the as-of join needs no
    second shuffle: windows and the final pivot all run on the ticker partitioning.  A bar finds its
    dates by position, two lookups whatever the number of dates and horizons.
    ``horizons`` adds the as-of close that many days after the snapshot.
    """
    d = _windowed(prices, key, with_averages=True).withColumn("_ask", _asked(dates, horizons).scalar())
    asked, first, counts = F.col("_ask.asked"), F.col("_ask.first"), F.col("_ask.counts")

    def until(day: Column) -> Column:
        """How many of the asked dates lie before ``day``: looked up by the day's place in the calendar."""
        at = F.datediff(day, first)
        return F.when(at <= 0, 0).when(at > F.size(counts), F.size(asked)).otherwise(F.get(counts, at - 1))
    d = d.withColumns({"_from": until(F.col("session")), "_to": F.when(F.col("next").isNull(), F.size(asked)).otherwise(until(F.col("next")))}).filter("_to > _from")
    d = d.withColumn("hit", F.explode(F.slice(F.col("_ask.asked"), F.col("_from") + 1, F.col("_to") - F.col("_from")))).withColumn("snapshot", F.col("hit.snapshot"))
    # only the bars that answer for a date get their ratios computed
    d = _finished(d, [key, "session", "close", "n", "snapshot", "macd_line", "macd_histogram", "hit"])
    here = F.col("hit.h") == 0
    aggs = [F.max(F.when(here, F.col("session"))).alias("session"), F.max(F.when(here, F.col("close"))).alias("price"),
            F.max(F.when(here, F.col("n"))).alias("bars")]
    aggs += [F.max(F.when(here, F.col(f))).alias(f) for f in FEATURES]
    aggs += [F.max(F.when(F.col("hit.h") == h, F.col("close"))).alias(f"close_{h}") for h in horizons]
    return d.groupBy(key, "snapshot").agg(*aggs).filter(F.col("price").isNotNull())


def macd_bars(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """MACD line and histogram at every bar."""
    return with_macd(numbered(prices.select(key, "session", "close"), key), key).drop("n", "block", "pos")


def momentum_12_1(r12: Column, r1: Column) -> Column:
    """Twelve-month return without its last month."""
    return F.when(r1 > -0.99, F.try_divide(r12 + 1.0, r1 + 1.0) - 1.0).otherwise(r12)


def with_sharpe_proxy(df: DataFrame) -> DataFrame:
    return df.withColumn("sharpe_proxy", sharpe_proxy("return_12m", "volatility_1y"))
