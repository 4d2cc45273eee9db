"""One row per asset: score, health diagnostics and the provider's research figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import finite

#: Zones a provider may report.
ZONES = ["safe", "grey", "distress"]


def deep_dive(scored: DataFrame, research: DataFrame, risks: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """Left chain on the ticker.  ``scored`` carries total, ``pio`` and ``alt``; ``research`` z_score and zone.

    The provider's Altman figure stands in only where the local one is unknown, and only as a whole:
    a finite score together with a known zone.
    """
    r = research.select(key, finite("z_score").alias("_z"), F.col("zone").alias("_zone"))
    d = scored.join(r, key, "left")
    usable = F.col("_z").isNotNull() & F.col("_zone").isin(ZONES)
    spare = F.when(usable, F.struct(F.col("_z").alias("z_score"), F.col("_zone").alias("zone")))
    d = d.withColumn("alt", F.coalesce("alt", spare)).drop("_z", "_zone")
    if risks is not None:
        counts = risks.groupBy(key).agg(F.count("*").alias("risk_count"), F.count_if(F.col("severity") == "high").alias("high_risks"))
        d = d.join(counts, key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("risk_count", "high_risks")})
    return d
