"""Portfolio review and candidate lists per region and asset class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import filters as L, ranking as R, scoring as S

#: Score bands, smallest sound portfolio, sector share that warns.
WEAK, STRONG = 40, 60
FEW_HOLDINGS, SECTOR_CHECK_FROM, SECTOR_LIMIT = 5, 3, 50.0


def band(total: Column) -> Column:
    return F.when(total < WEAK, "weak").when(total < STRONG, "moderate").otherwise("strong")


def portfolio_review(scored: DataFrame, group: list[str]) -> DataFrame:
    """One row per portfolio: counts per band, mean score, warning flags and crowded sectors."""
    sector = F.coalesce("sector", F.lit("Unknown"))
    per_sector = scored.groupBy(*group, sector.alias("sector")).agg(
        F.count("*").alias("n"), F.sum("total").alias("score"),
        *[F.count_if(band(F.col("total")) == b).alias(b) for b in ("weak", "moderate", "strong")])
    total = per_sector.groupBy(*group).agg(
        F.sum("n").alias("count"), F.sum("score").alias("_score"), *[F.sum(b).alias(b) for b in ("weak", "moderate", "strong")],
        F.array_sort(F.collect_list(F.struct("sector", "n"))).alias("_s"))
    share = lambda s: s["n"] * 100.0 / F.col("count")
    crowded = F.when(F.col("count") >= SECTOR_CHECK_FROM, F.transform(F.filter("_s", lambda s: share(s) > SECTOR_LIMIT), lambda s: s["sector"]))
    avg = F.bround(F.when(F.col("count") > 0, F.try_divide("_score", "count")).otherwise(0.0), 1)
    return total.select(*group, "count", "weak", "moderate", "strong", avg.alias("avg_score"), (F.col("count") < FEW_HOLDINGS).alias("few_holdings"),
                        F.coalesce(F.array_join(crowded, ", "), F.lit("")).alias("crowded_sectors"), F.size("_s").alias("sectors"))


def candidates(scored: DataFrame, held: DataFrame, held_count: int, n: int, profile: str, key: str = "symbol") -> DataFrame:
    """Interactive form: oversample, drop held names, tilt, sort again, cut."""
    wide = scored.orderBy(F.col("total").desc(), key).limit(n + held_count)
    d = L.exclude(wide, held, key).withColumn("total", S.risk_tilt(F.col("total"), F.col("sector"), profile))
    return d.orderBy(F.col("total").desc(), key).limit(n)


def comprehensive(scored: DataFrame, held: DataFrame, group: list[str], n: int, profile: str, key: str = "symbol") -> DataFrame:
    """Batch form over all groups at once: cut first, then drop held names, then tilt."""
    cut = R.top_n(scored, group, n, key).drop("rank")
    d = L.exclude(cut, held, key)
    return d.withColumn("total", S.risk_tilt(F.col("total"), F.col("sector"), profile))
