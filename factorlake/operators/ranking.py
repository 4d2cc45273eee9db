"""Ranks over whole cross-sections without ever putting a cross-section into one task.

A snapshot can hold billions of assets and one score value (the neutral cap) a third of them, so an
ordinary ``rank() over (partition by date)`` would need one task per date.  Here rows are sorted by
range on (group, value, key) and counted per range; a range then only needs the number of rows before
it.  The key takes part in the ranges, so the rows of one hot value spread over several of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stable


def positions(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """Adds ``_below`` (rows with a smaller value), ``_ties`` (rows with this value), ``_ordinal``
    (1-based position by value, then ``key``) and ``_size`` per group.

    NULL values get no position.  ``key`` is of any type that sorts, unique within the group.  There is one
    plan for every size: the ranges are stored, so their numbers are fixed, and the windows that order
    whole groups see one row per range of the group.
    """
    # adding 0.0 folds -0.0 into 0.0 so that equal values are ties
    d = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double") + F.lit(0.0))
    d = stable(d.repartitionByRange(*group, "_v", key).withColumn("_range", F.spark_partition_id()))
    cell = [*group, "_range"]
    inside = d.withColumns({"_o": F.row_number().over(Window.partitionBy(*cell).orderBy("_v", key)), "_n": F.count("*").over(Window.partitionBy(*cell, "_v"))})
    inside = inside.withColumn("_first", F.min("_o").over(Window.partitionBy(*cell, "_v")))
    ranges = d.groupBy(*cell).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_rows")
    ranges = ranges.select(*cell, before.alias("_before"), F.sum("_rows").over(Window.partitionBy(*group)).alias("_size"))
    placed = inside.join(ranges, cell).withColumn("_ordinal", F.col("_before") + F.col("_o"))
    # a value lies whole in most ranges; where it spans several, each of them holds it at one edge
    values = d.groupBy(*cell, "_v").agg(F.count("*").alias("_m")).join(ranges.select(*cell, "_before"), cell)
    edge = Window.partitionBy(*cell)
    edges = values.withColumns({"_lo": F.min("_v").over(edge), "_hi": F.max("_v").over(edge), "_all": F.sum("_m").over(edge)}).filter("_v = _lo OR _v = _hi")
    start = F.col("_before") + F.when(F.col("_v") == F.col("_lo"), F.lit(0)).otherwise(F.col("_all") - F.col("_m"))
    whole = Window.partitionBy(*group, "_v")
    edges = edges.select(*cell, "_v", F.sum("_m").over(whole).alias("_t"), F.min(start).over(whole).alias("_b"))
    return placed.join(edges, [*cell, "_v"], "left").select(
        *df.columns, "_ordinal", F.coalesce("_t", "_n").alias("_ties"), F.coalesce("_b", F.col("_before") + F.col("_first") - 1).alias("_below"), "_size")


def value_ranks(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """(group..., ``_side``, ``_v``, ``_rank``, ``_size``): the average rank of every different value of each named column.

    Rows are first counted per value, with map-side combine, so a value that a third of all rows share is one
    row from there on. The counts of all columns are sorted by range once and stored; a range adds up its
    own counts, and only one total per range and group is added up over the ranges. NULL values have no rank.
    """
    # adding 0.0 folds -0.0 into 0.0 so that equal values are ties
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), (F.col(v).cast("double") + F.lit(0.0)).alias("_v")) for i, v in enumerate(values)])
    counted = df.select(*group, F.explode(sides).alias("_s")).select(*group, "_s._side", "_s._v").filter("_v IS NOT NULL").groupBy(*group, "_side", "_v").agg(F.count("*").alias("_m"))
    d = stable(counted.repartitionByRange(*group, "_side", "_v").withColumn("_range", F.spark_partition_id()))
    column, cell = [*group, "_side"], [*group, "_side", "_range"]
    so_far = F.sum("_m").over(Window.partitionBy(*cell).orderBy("_v"))
    ranges = d.groupBy(*cell).agg(F.sum("_m").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*column).orderBy("_range")) - F.col("_rows")
    ranges = ranges.select(*cell, before.alias("_before"), F.sum("_rows").over(Window.partitionBy(*column)).alias("_size"))
    placed = d.withColumn("_to", so_far).join(ranges, cell)
    rank = F.col("_before") + F.col("_to") - F.col("_m") + (F.col("_m") + 1) / 2.0
    return placed.select(*column, "_v", rank.alias("_rank"), "_size")


def _with_rank(df: DataFrame, ranks: DataFrame, group: list[str], value: str, side: int, out: str, centred: bool) -> DataFrame:
    r = ranks.filter(F.col("_side") == side).select(*group, "_v", (F.col("_rank") - (F.col("_size") + 1) / 2.0 if centred else F.col("_rank")).alias(out))
    return df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0)).join(r, [*group, "_v"]).drop("_v")


def average_rank(df: DataFrame, group: list[str], value: str, key: str, out: str) -> DataFrame:
    """Rank with ties averaged, 1-based; rows without a value are left out."""
    return _with_rank(df, value_ranks(df, group, [value]), group, value, 0, out, False).select(*df.columns, out)


def percentile_score(df: DataFrame, group: list[str], value: str, key: str, out: str, higher_better: bool = True) -> DataFrame:
    """Ordinal position over ``m - 1``, times 100; only the ranked rows are returned."""
    d = positions(df, group, value, key)
    pct = F.try_divide((F.col("_ordinal") - 1).cast("double"), (F.col("_size") - 1).cast("double")) * 100.0
    score = pct if higher_better else F.lit(100.0) - pct
    return d.withColumn(out, F.when(F.col("_size") >= 2, score).otherwise(50.0)).drop("_below", "_ties", "_ordinal", "_size")


def top_n(df: DataFrame, group: list[str], n: int, tie: str = "ticker", score: str = "total") -> DataFrame:
    """The best ``n`` per group.  The rank filter lets Spark cut each partition to ``n`` rows per group
    before the shuffle, so a group never arrives whole."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def top_n_many(df: DataFrame, group: list[str], ns: list[int], tie: str = "ticker", score: str = "total") -> DataFrame:
    """Several cut-offs from one ranking: one row per pick and cut-off it belongs to."""
    ranked = top_n(df, group, max(ns), tie, score)
    cuts = F.filter(F.array(*[F.lit(n).cast("bigint") for n in ns]), lambda n: n >= F.col("rank"))
    return ranked.withColumn("n", F.explode(cuts))


def spearman(df: DataFrame, group: list[str], x: str, y: str, key: str, min_pairs: int = 5) -> DataFrame:
    """Rank correlation per group over rows where both values are known.

    Pearson over average ranks; no result below ``min_pairs`` rows or with a constant side.  The mean
    rank is always (n + 1) / 2, so centred ranks need one pass of plain sums.  ``df`` is read twice, for the
    counts and for the pairs: hand in a stored table.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, key, x, y)
    ranks = value_ranks(both, group, [x, y])
    ranked = _with_rank(_with_rank(both, ranks, group, x, 0, "_rx", True), ranks, group, y, 1, "_ry", True)
    out = ranked.groupBy(*group).agg(
        F.count("*").alias("pairs"), F.sum(F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(F.col("_ry") * F.col("_ry")).alias("_yy"))
    ok = (F.col("pairs") >= min_pairs) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    return out.filter(ok).select(*group, "pairs", F.try_divide("_xy", F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("ic"))
