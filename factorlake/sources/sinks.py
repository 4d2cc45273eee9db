"""Writers.  All of them write from the executors; nothing passes through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .upsert import upsert


def write_report(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str, tag: str, config: dict[str, str]) -> None:
    """Tagged metrics with their run configuration; one folder per tag, other tags stay."""
    cfg = F.create_map(*[F.lit(x) for kv in config.items() for x in kv]) if config else F.create_map().cast("map<string,string>")
    (metrics.withColumn("config", cfg).withColumn("tag", F.lit(tag)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("tag").json(path))


def write_ic(ic: DataFrame, path: str) -> None:
    ic.write.mode("overwrite").option("header", True).csv(path)


def save_periods(periods: DataFrame, path: str, buckets: int = 64, key: str = "ticker") -> None:
    """Stores parsed periods by ticker bucket; a ticker that arrives replaces what it had, one that does not keeps it.

    Only the buckets of the arriving tickers are read and rewritten (see ``upsert``).
    """
    def merge(fresh: DataFrame, stored: DataFrame | None) -> DataFrame:
        return fresh if stored is None else fresh.unionByName(stored.join(fresh.select(key).distinct(), key, "left_anti"))
    upsert(periods.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets))), path, ["bucket"], merge, uuid.uuid4().hex)


def inventory(periods: DataFrame, key: str = "ticker") -> DataFrame:
    """Per ticker: fiscal periods, newest filing, whether a predecessor was stitched in."""
    return periods.groupBy(key).agg(F.countDistinct("period_end").alias("periods"), F.max("date_filed").alias("last_filed"),
                                    F.max(F.coalesce("stitched", F.lit(False)) if "stitched" in periods.columns else F.lit(False)).alias("stitched"))


def save_prices(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Bars by month of session, as ``readers.price_rows`` expects them."""
    columns = ["ticker", "session", "open", "high", "low", "close", "adjclose", "volume"]
    writer = bars.select(*columns, "month").write.mode("overwrite").partitionBy("month")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def save_footnotes(footnotes: DataFrame, path: str) -> None:
    """Parsed payloads by kind."""
    footnotes.select("ticker", "payload", "broken", "kind").write.mode("overwrite").partitionBy("kind").parquet(path)


def write_source_comparison(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def save_by_ticker(df: DataFrame, table: str, path: str, buckets: int, order: list[str], key: str = "ticker") -> None:
    """Stores a table bucketed by ticker: later windows, groupings and joins on the ticker need no shuffle.

    Use one bucket count for prices, facts, dividends and earnings.
    """
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table))
