"""Upserts that rewrite only the partitions a batch touches and survive a failure at any point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import stable


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _copies(spark: SparkSession, table: str) -> list[str]:
    """Complete copies of partitions that may not have reached the table yet, oldest first."""
    fs, p = _fs(spark, f"{table}.pending")
    if not fs.exists(p):
        return []
    done = [s for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [s.getPath().toString() for s in sorted(done, key=lambda s: s.getModificationTime())]


def _publish(spark: SparkSession, copy: str, table: str, parts: list[str], schema) -> None:
    spark.read.schema(schema).parquet(copy).repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(table)
    fs, p = _fs(spark, copy)
    fs.delete(p, True)


def upsert(fresh: DataFrame, table: str, parts: list[str], merge: Callable[[DataFrame, DataFrame | None], DataFrame], batch: str) -> None:
    """Merges ``fresh`` into the parquet ``table`` partitioned by ``parts``.

    Only partitions with fresh rows are read and replaced: ``merge(fresh, stored)`` gets their stored rows
    (None for a new table) and returns their new content. That content is first written as a complete copy beside the
    table; only then are the partitions overwritten and the copy removed. A copy that a failed run has
    left is published before anything else, so a failure costs no row, and a merge that gives the same
    result twice makes a replayed batch change nothing. An empty batch touches no file.
    """
    spark = fresh.sparkSession
    for copy in _copies(spark, table):
        _publish(spark, copy, table, parts, fresh.schema)
    fresh = stable(fresh)
    if fresh.isEmpty():
        return
    stored = None
    if exists(spark, table):
        stored = spark.read.schema(fresh.schema).parquet(table).join(fresh.select(*parts).distinct(), parts, "left_semi").select(*fresh.columns)
    copy = f"{table}.pending/{batch}"
    merge(fresh, stored).select(*fresh.columns).write.mode("overwrite").parquet(copy)
    _publish(spark, copy, table, parts, fresh.schema)
