"""Running totals over rows in a global order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stable


def running_totals(rows: DataFrame, group: str | None, order: list, value: str, out: str) -> DataFrame:
    """``rows`` plus ``out``: the sum of ``value`` over the earlier rows of the same ``group`` (all rows if None).

    Rows are sorted by range on (group, order), so a group of any size spans as many ranges as it needs; every
    range adds up its own rows in one pass and is stored, then only one total per (range, group) is
    accumulated over the ranges. ``value`` is a long without nulls, ``group`` a string (null is a group of
    its own), ``order`` holds sort columns; rows equal in all of them take any order among themselves.
    """
    key = F.col(group) if group else F.lit(None).cast("string")
    lead = [F.col("__rt_group").asc_nulls_last()] if group else []
    sortable = rows.withColumn("__rt_group", key).repartitionByRange(*lead, *order).sortWithinPartitions(*lead, *order).withColumn("__rt_part", F.spark_partition_id())
    names = sortable.columns
    at, g = names.index(value), names.index("__rt_group")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = (), 0  # an empty tuple is no group
        for b in batches:
            v, keys = b.column(at).to_numpy(zero_copy_only=False), b.column(g)
            if not len(v):
                continue
            sums = np.cumsum(v)
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            lengths = np.diff(np.append(first, len(v)))
            before = sums - v - np.repeat(sums[first] - v[first], lengths)
            if keys[0].as_py() == last:
                before[:lengths[0]] += total
            else:
                total = 0
            last = keys[len(v) - 1].as_py()
            total = int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], names=[*names, "__rt_inside"])

    done = stable(sortable.mapInArrow(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sortable.schema) + ", __rt_inside long"))
    ranges = done.groupBy("__rt_group", "__rt_part").agg(F.sum(value).alias("__rt_sum"))
    before = Window.partitionBy("__rt_group").orderBy("__rt_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stable(ranges.select(F.col("__rt_group").alias("__rt_g"), F.col("__rt_part").alias("__rt_p"), F.coalesce(F.sum("__rt_sum").over(before), F.lit(0)).alias("__rt_before")))
    joined = done.join(ranges, (F.col("__rt_part") == F.col("__rt_p")) & F.col("__rt_group").eqNullSafe(F.col("__rt_g")))
    return joined.withColumn(out, F.col("__rt_inside") + F.col("__rt_before")).drop("__rt_group", "__rt_part", "__rt_inside", "__rt_g", "__rt_p", "__rt_before")
