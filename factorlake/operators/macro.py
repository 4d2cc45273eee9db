"""Market regime, computed for every session of the index series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio

# Regime thresholds and the impact of each input on the score.
VOL_CRASH, VOL_BEARISH, VOL_NEUTRAL = 35, 25, 15
HEALTHY, NEUTRAL, WARNING = 70, 45, 25
SECTOR_MAP = {
    "healthy": ["Technology", "Financials", "Consumer Cyclical", "Communication Services"],
    "neutral": ["Healthcare", "Technology", "Industrials"],
    "warning": ["Healthcare", "Utilities", "Consumer Staples", "Energy"],
    "danger": ["Utilities", "Healthcare", "Consumer Staples", "Cash"],
}
ALL_SECTORS = ["Technology", "Financial Services", "Healthcare", "Energy", "Consumer Cyclical",
               "Consumer Defensive", "Utilities", "Real Estate"]


def volatility_regime(v: Column) -> Column:
    return (F.when(v.isNull(), "unknown").when(v > VOL_CRASH, "crash").when(v > VOL_BEARISH, "bearish")
            .when(v > VOL_NEUTRAL, "neutral").otherwise("bullish"))


def regime_action(regime: Column) -> Column:
    return F.when(regime == "crash", "sell").when(regime.isin("bearish", "unknown"), "hold").otherwise("buy")


def percentile_of_last(series: DataFrame, key: str, days: int = 730, min_points: int = 20) -> DataFrame:
    """Share of closes strictly below the last one, per key, over the trailing window."""
    w = Window.partitionBy(key).orderBy("session").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = (series.filter(F.col("close").isNotNull()).withColumn("_last", F.last("close").over(w))
         .withColumn("_day", F.last("session").over(w)).filter(F.col("session") > F.date_sub("_day", days)))
    out = d.groupBy(key).agg(F.count("*").alias("points"), F.count_if(F.col("close") < F.col("_last")).alias("below"))
    return out.filter(F.col("points") >= min_points).withColumn("pct_rank", F.round(F.col("below") / F.col("points") * 100, 1))


def percentile_level(p: Column) -> Column:
    return (F.when(p.isNull(), "unknown").when((p > 90) | (p < 15), "high").when(p < 30, "medium").otherwise("low"))


def five_session_trend(series: DataFrame, key: str = "symbol") -> DataFrame:
    """Percent change from the first to the last of five sessions."""
    first = F.lag("close", 4).over(Window.partitionBy(key).orderBy("session"))
    return series.withColumn("trend_5d", F.round(ratio(F.col("close") - first, first) * 100, 2))


def yield_spread(ten: Column, two: Column, official_ten: Column, official_two: Column) -> Column:
    """Both tenors from the index pair, else both from the official curve: never one of each."""
    return F.when(ten.isNotNull() & two.isNotNull(), ten - two).otherwise(official_ten - official_two)


def _trend(t: Column) -> Column:
    return F.when(t < 0, 1).when(t > 0, -1).otherwise(0)


def macro_score(vol: Column, spread: Column, bond_vol: Column, dollar: Column, sentiment: Column,
                vol_trend: Column, bond_trend: Column, dollar_trend: Column) -> Column:
    """50, five inputs worth up to ten points each way, three trends worth one; clamped to 0..100."""
    regime = volatility_regime(vol)
    score = F.lit(50)
    score = score + F.when(regime == "crash", -10).when(regime == "bearish", -5).when(regime == "bullish", 10).otherwise(0)
    score = score + F.when(spread < 0, -10).when(spread < 0.5, -5).when(spread > 1.0, 10).otherwise(0)
    score = score + F.when(bond_vol > 120, -10).when(bond_vol > 100, -5).when(bond_vol < 60, 10).otherwise(0)
    score = score + F.when(dollar > 105, -10).when(dollar > 100, -5).when(dollar < 95, 10).otherwise(0)
    score = score + (F.when(sentiment < 25, 10).when(sentiment < 45, 5).when(sentiment > 75, -10)
                     .when(sentiment > 55, -5).otherwise(0))
    score = score + _trend(vol_trend) + _trend(bond_trend) + _trend(dollar_trend)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def macro_regime(score: Column) -> Column:
    return F.when(score >= HEALTHY, "healthy").when(score >= NEUTRAL, "neutral").when(score >= WARNING, "warning").otherwise("danger")


def macro_action(score: Column) -> Column:
    return F.when(score >= HEALTHY, "buy").when(score >= WARNING, "hold").otherwise("sell")


def preferred_sectors(regime: Column) -> Column:
    table = F.create_map(*[x for k, v in SECTOR_MAP.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.try_element_at(table, regime)


def macro_table(series: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """One row per session: role columns (vol, ten, two, bond_vol, dollar, sentiment) and their trends.

    ``symbols`` maps role -> symbol.  A conditional aggregate per session, the role set is fixed.
    """
    d = five_session_trend(series)
    aggs = []
    for role, symbol in symbols.items():
        here = F.col("symbol") == symbol
        aggs += [F.max(F.when(here, F.col("close"))).alias(role), F.max(F.when(here, F.col("trend_5d"))).alias(f"{role}_trend")]
    return d.groupBy("session").agg(*aggs)


def filing_pulse(filings: DataFrame, until: Column, days: int = 30, k: int = 5) -> DataFrame:
    """Counts per kind over the trailing days and the first ``k`` distinct symbols, newest first.

    Only the ``k`` best rows per kind are collected; the rank filter cuts every partition beforehand.
    """
    recent = filings.filter((F.col("ts") <= until) & (F.col("ts") > until - F.expr(f"INTERVAL {days} DAYS")))
    counts = recent.groupBy("kind").agg(F.count("*").alias("filings"))
    seen = recent.filter(F.trim("symbol") != "").groupBy("kind", F.trim("symbol").alias("symbol")).agg(F.max("ts").alias("at"))
    order = Window.partitionBy("kind").orderBy(F.col("at").desc(), "symbol")
    top = seen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    names = top.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "symbol"))), lambda x: x["symbol"]), ",").alias("symbols"))
    return counts.join(names, "kind", "left")


def trend_direction(first: Column, last: Column, known: Column, min_delta: float = 0.0, min_rel: float = 0.0) -> Column:
    """'up', 'down' or 'flat' between the first and last of the ``known`` values of a series; NULL below two of them."""
    limit = F.greatest(F.lit(min_delta), F.abs(first) * min_rel)
    move = last - first
    return F.when(known < 2, F.lit(None)).when(F.abs(move) <= limit, "flat").when(move > 0, "up").when(move < 0, "down")
