"""Streams over the event table, driven over everything available and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import driver_views as V
from ..streaming import keyed_state as KS, market_streams as ST
from .registry import query, rnd


def _events(spark, sf_dir):
    raw = spark.readStream.schema(V.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_batches(spark, sf_dir, batches: int = 4):
    """The events landed as files in order of time, read in several micro-batches; files and files per batch grow with the table."""
    events = V.read(spark, sf_dir, "events")
    source = f"{_folder(spark)}/events"
    rows = max(1, min(1_000_000, events.count() // batches))
    events.repartitionByRange("ts").sortWithinPartitions("ts").write.option("maxRecordsPerFile", rows).parquet(source)
    landed = spark.read.schema(events.schema).parquet(source)
    per_batch = max(1, -(-len(landed.inputFiles()) // batches))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_batch).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))


def _feed_in_order(spark, sf_dir, base: str, changes, batches: int = 4) -> None:
    """Lands the events in time slices and runs the stream after each, so that a micro-batch never holds what is late for the one before.

    Files of one job close in any order and a stream reads them by that time; slices of separate jobs cannot overtake each other.
    What expires is written below ``base``/expired.
    """
    events = V.read(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    if first is None:  # no event: one empty batch
        first = last = 0
    bounds = [F.timestamp_micros(F.lit(first + (last - first) * i // batches)).cast(events.schema["ts"].dataType) for i in range(batches)]
    for i in range(batches):
        part = F.col("ts") >= bounds[i]
        events.where(part & (F.col("ts") < bounds[i + 1]) if i + 1 < batches else part).write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/events").withColumn("ts", F.col("ts").cast("timestamp"))
        with KS.rocks_state(spark):
            _feed(changes(stream), lambda d, n: d.write.mode("overwrite").parquet(f"{base}/expired/batch={n}"), f"{base}/state")


def _feed(stream, apply, state: str, mode: str = "append") -> None:
    stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _folder(spark) -> str:
    """A new folder below the shared checkpoint directory."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _drain(spark, stream):
    base = _folder(spark)
    ST.run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_daily_bars", "STR-1 FLT-8", """SELECT event_type, CAST(ts AS DATE) AS session, ROUND(CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * COUNT(*) AS DOUBLE), 6) AS close, MAX(value) AS high, MIN(value) AS low, COUNT(*) AS ticks
 FROM events WHERE CAST(ts AS DATE) + 1 <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_daily_bars(spark, sf_dir):
    d = _drain(spark, ST.daily_bars(_events(spark, sf_dir)))
    return d.select("event_type", "session", rnd("close").alias("close"), "high", "low", "ticks")


@query("stream_filing_pulse", "STR-3", """SELECT event_type AS kind, CAST(u AS DATE) AS until, COUNT(*) AS filings FROM events, (SELECT UNNEST(generate_series(DATE '2023-12-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS u)
 WHERE ts >= u - INTERVAL 30 DAY AND ts < u AND u <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_filing_pulse(spark, sf_dir):
    f = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"))
    return _drain(spark, ST.filing_pulse(f))


KEYS = ["event_type", "user_id"]


@query("stream_latest_per_key", "STR-4", """SELECT event_type, user_id, MAX_BY(value, (ts, event_id)) AS value, MAX_BY(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2
 HAVING MAX(ts) >= (SELECT MAX(ts) FROM events) - INTERVAL 10 DAY""")
def stream_latest_per_key(spark, sf_dir):
    """Several micro-batches; a key without a record in the last ten days leaves the state, which is the result."""
    base, ttl = _folder(spark), "10 days"
    _feed_in_order(spark, sf_dir, base, lambda e: KS.newest_until_expiry(e.select("ts", "event_id", "event_type", "user_id", "value"), KEYS, ["event_id"], ttl))
    return KS.live_records(spark, f"{base}/state", KEYS, ttl).select("event_type", "user_id", "value", "event_id")


@query("stream_expired_keys", "STR-4", """SELECT event_type, COUNT(*) AS keys, COUNT(*) FILTER (newest < (SELECT MAX(ts) FROM events) - INTERVAL 10 DAY) AS expired FROM (
 SELECT event_type, user_id, MAX(ts) AS newest FROM events GROUP BY 1, 2) GROUP BY 1""")
def stream_expired_keys(spark, sf_dir):
    """Keys ever seen, which the state holds or has given out, and those without a live record."""
    base, ttl = _folder(spark), "10 days"
    _feed_in_order(spark, sf_dir, base, lambda e: KS.newest_until_expiry(e.select("ts", "event_id", "event_type", "user_id"), KEYS, ["event_id"], ttl))
    live = KS.live_records(spark, f"{base}/state", KEYS, ttl).select(*KEYS, F.lit(1).alias("live"))
    held = spark.read.format("statestore").load(f"{base}/state").select("key.event_type", "key.user_id", F.lit(0).alias("live"))
    gone = spark.read.parquet(f"{base}/expired").select(*KEYS, F.lit(0).alias("live"))
    keys = live.unionByName(held).unionByName(gone).groupBy(*KEYS).agg(F.max("live").alias("live"))
    return keys.groupBy("event_type").agg(F.count("*").alias("keys"), F.count_if(F.col("live") == 0).alias("expired"))


@query("stream_bar_upsert", "STR-2 JOIN-17", """SELECT event_type AS ticker, CAST(ts AS DATE) AS session, MAX_BY(value, (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, ts, value)) AS close,
 CASE WHEN MAX(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) = 1 THEN 'bar' ELSE 'quote' END AS origin FROM events GROUP BY 1, 2""")
def stream_bar_upsert(spark, sf_dir):
    base = _folder(spark)
    e = _in_batches(spark, sf_dir).select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("session"), F.col("value").alias("close"),
                                          F.when(F.col("event_id") % 3 == 0, "quote").otherwise("bar").alias("origin"), F.col("ts").alias("seen_at"))
    _feed(e, ST.bar_upsert(f"{base}/bars"), f"{base}/state")
    return ST.read_bars(spark, f"{base}/bars").select("ticker", "session", "close", "origin")
