"""Consensus of disclosed holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X

#: Fixed value: share class that is merged into its twin.
MERGED_CLASS = {"GOOG": "GOOGL"}


def consensus(holdings: DataFrame, min_overlap: int = 2, weight: str = "pct", merged: dict[str, str] = MERGED_CLASS) -> DataFrame:
    """Managers and summed weight per symbol, most held first.

    Merging a share class adds its counts, so a manager that holds both counts twice.
    """
    sym = F.upper(F.translate(F.col("symbol"), ".", "-"))
    table = F.create_map(*[x for a, b in merged.items() for x in (F.lit(a), F.lit(b))])
    d = holdings.withColumn("symbol", F.coalesce(F.try_element_at(table, sym), sym))
    out = d.groupBy("symbol").agg(F.count("*").alias("manager_count"), F.sum(weight).alias("total_weight"))
    return out.filter((F.col("manager_count") >= min_overlap) & X.is_ticker("symbol"))


def consensus_order(df: DataFrame) -> list:
    return [F.col("manager_count").desc(), F.col("total_weight").desc(), F.col("symbol").asc()]


def attach_holders(scores: DataFrame, counts: DataFrame, key: str = "ticker") -> DataFrame:
    """Manager count on the upper-cased ticker; size decides whether Spark broadcasts."""
    c = counts.select(F.col("symbol").alias("_s"), F.col("manager_count").alias("superinvestor_count"))
    return scores.join(c, F.upper(F.col(key)) == F.col("_s"), "left").drop("_s")


def report_quarter(periods: DataFrame) -> DataFrame:
    """Stated quarters by number of managers, ties by label; rank 1 is the quarter of the aggregate."""
    counts = periods.groupBy("period").agg(F.count("*").alias("managers"))
    # quarters in one disclosure cycle: a handful of rows
    w = Window.orderBy(F.col("managers").desc(), "period")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint"))


def audit_universe(curated: DataFrame, counts: DataFrame, quotes: DataFrame, min_overlap: int, min_cap: float | None,
                   by_design: list[str] | None = None) -> DataFrame:
    """What changed between a curated list and the aggregate: dropped, thin, missing, excluded (reason).

    ``counts`` is the aggregate with ``min_overlap=1``.
    """
    cur = curated.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_cur", F.lit(True))
    d = cur.join(counts.select("symbol", "manager_count"), "symbol", "full_outer").join(
        quotes.select("symbol", "asset_type", "market_cap"), "symbol", "left")
    listed = F.coalesce(F.col("_cur"), F.lit(False))
    enough = F.col("manager_count") >= min_overlap
    reason = F.lit(None).cast("string")
    if min_cap is not None:
        reason = (F.when(F.upper("asset_type").isin("ETF", "MUTUALFUND"), "fund").when(F.col("market_cap").isNull(), "no market cap")
                  .when(F.col("market_cap") < min_cap, "below floor"))
    status = (F.when(listed & F.col("manager_count").isNull(), "dropped").when(listed & ~enough, "thin")
              .when(~listed & enough & reason.isNotNull(), "excluded").when(~listed & enough, "missing"))
    d = d.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "excluded", reason))
    if by_design:
        d = d.filter(listed | ~F.col("symbol").isin(by_design))
    return d.filter(F.col("status").isNotNull()).select("symbol", "manager_count", "status", "reason")
