"""Session finality: bars and quotes of a day that has not closed yet, and bars that arrive late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import EXCHANGE_ZONE, quote_instant, session_close, session_open


def drop_partial_session(prices: DataFrame, now: Column, key: str = "ticker") -> DataFrame:
    """Removes the last bar of a ticker while its session has not closed at 16:00 New York."""
    w = Window.partitionBy(key).orderBy("session")
    d = prices.withColumn("_last", F.lead("session").over(w).isNull())
    return d.filter(~F.col("_last") | (now >= session_close("session"))).drop("_last")


def reconcile_quote_session(prices: DataFrame, quotes: DataFrame, now: Column, key: str = "ticker") -> DataFrame:
    """Appends one close-only bar where a closed quote is newer than the last bar that has a close.

    Only the regular (else current) price is known, so only the close is filled.
    """
    closes = prices.filter(F.col("close").isNotNull())
    last = closes.groupBy(key).agg(F.max("session").alias("_last"))
    price = F.coalesce(F.col("regular_price"), F.col("current_price"))
    q = quotes.select(key, quote_instant("quoted_at").alias("_at"), price.alias("close"))
    q = q.filter((F.col("close") > 0) & F.col("_at").isNotNull() & ~session_open(F.col("_at"), now))
    late = (q.join(last, key).withColumn("session", F.to_date(F.from_utc_timestamp("_at", EXCHANGE_ZONE)))
            .filter(F.col("session") > F.col("_last")).select(key, "session", "close"))
    # a placeholder bar of that very session (no close yet) gives way to the repaired one
    kept = prices.filter(F.col("close").isNotNull()) if set(prices.columns) == {key, "session", "close"} else \
        prices.join(late.select(key, "session"), [key, "session"], "left_anti")
    return kept.unionByName(late, allowMissingColumns=True)
