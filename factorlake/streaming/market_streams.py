"""Streaming twins: final bars, quote repair, filing counts, latest record per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import ratio
from ..sources.upsert import upsert


def daily_bars(ticks: DataFrame, key: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """Bars of closed days only: in append mode a day is emitted once the watermark has passed its end."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    w = F.window("ts", "1 day")
    d = ticks.withWatermark("ts", delay).groupBy(w, key).agg(
        F.sum(cents).alias("total"), F.count("*").alias("ticks"), F.max("value").alias("high"), F.min("value").alias("low"))
    return d.select(key, F.to_date("window.start").alias("session"), ratio("total", F.col("ticks") * 100).alias("close"), "high", "low", "ticks")


def filing_pulse(filings: DataFrame, kind: str = "kind", delay: str = "1 day") -> DataFrame:
    """30-day counts per kind, sliding by a day."""
    w = F.window("ts", "30 days", "1 day")
    d = filings.withWatermark("ts", delay).groupBy(w, kind).agg(F.count("*").alias("filings"))
    return d.select(kind, F.to_date("window.end").alias("until"), "filings")


def newest_per_key(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record per key; ``order`` ranks the records of a key."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merge_bars(bars: DataFrame, key: str = "ticker", last: list[str] | None = None) -> DataFrame:
    """One bar per (ticker, session): a real bar outranks a quote bar, a later one of a kind wins, then the higher close, then ``last``.

    Columns: key, session, close, origin ('bar' or 'quote'), seen_at.
    """
    ranked = bars.withColumn("_real", (F.col("origin") == "bar").cast("int"))
    return newest_per_key(ranked, [key, "session"], ["_real", "seen_at", "close", *(last or [])]).drop("_real")


def bar_upsert(table: str, key: str = "ticker", buckets: int = 16):
    """``foreachBatch`` function that merges a micro-batch of bars into the table that ``read_bars`` reads.

    The table is partitioned by month and ticker bucket; a batch reads and replaces only the partitions it
    has bars for. ``batch`` names the batch a bar came from, so a replay can be told from a new batch: it changes nothing.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        placed = {"month": F.date_format("session", "yyyy-MM"), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")}
        fresh = merge_bars(batch, key).withColumn("batch", F.lit(batch_id).cast("long")).withColumns(placed)

        def merge(new: DataFrame, stored: DataFrame | None) -> DataFrame:
            # of equal bars the one stored first stays
            both = new if stored is None else stored.unionByName(new)
            return merge_bars(both.withColumn("_first", -F.col("batch")), key, ["_first"])
        upsert(fresh, table, ["month", "bucket"], merge, f"batch={batch_id}")
    return apply


def read_bars(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop("month", "bucket")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drives a stream over everything available into a parquet folder and stops."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
