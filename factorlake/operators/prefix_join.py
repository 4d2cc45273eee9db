"""Which names start with which query: an ordered merge of both, linear in their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stable


def best_by_prefix(queries: DataFrame, names: DataFrame, n: int = 2) -> DataFrame:
    """(q, id, weight): the ``n`` heaviest of ``names(name, id, weight)`` that start with each of ``queries(q)``, the smaller id at a tie.

    Queries and names are sorted by range in one order, where the names of a query follow it without a gap.
    A range is streamed once with a stack of the queries that are still open; a query that is open when a
    range begins is a prefix of its first string, so only the prefixes of one string per range are looked
    up, whatever the names share. Names that begin alike, or are alike, spread over as many ranges as they need.
    """
    q = queries.select(F.col("q").alias("s")).filter("length(s) > 0").distinct().select("s", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("weight"))
    rows = q.unionByName(names.select(F.col("name").alias("s"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.col("weight").cast("long").alias("weight")).filter("length(s) > 0"))
    order = ["s", "kind", "id"]
    placed = stable(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    first = placed.groupBy("range").agg(F.min("s").alias("first"))
    heads = first.select("range", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda k: F.substring("first", F.lit(1), k))).alias("s"))
    home = placed.filter("kind = 0").select("s", F.col("range").alias("home"))
    carried = heads.join(home, "s").filter("home < range").select("s", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("weight"), "range")
    stream = placed.unionByName(carried).repartition("range").sortWithinPartitions("range", *order)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, at, done = [], None, []

        def close(keep: int) -> None:
            while len(open_) > keep:
                query, best = open_.pop()
                done.extend((query, i, -w) for w, i in best)
        for b in batches:
            for s, kind, i, w, r in zip(b["s"], b["kind"], b["id"], b["weight"], b["range"]):
                if r != at:
                    close(0)
                    at = r
                keep = len(open_)
                while keep and not s.startswith(open_[keep - 1][0]):
                    keep -= 1
                close(keep)
                if kind == 0:
                    open_.append((s, []))
                else:
                    for _, best in open_:
                        best.append((-int(w), int(i)))
                        best.sort()
                        del best[n:]
            if done:
                yield pd.DataFrame(done, columns=["q", "id", "weight"])
                done.clear()
        close(0)
        if done:
            yield pd.DataFrame(done, columns=["q", "id", "weight"])

    found = stream.mapInPandas(merge, "q string, id long, weight long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("weight"), "id"))
    return found.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")
