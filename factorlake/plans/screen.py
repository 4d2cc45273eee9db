"""Screening: universe -> features -> scores -> filters -> top-N -> report rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..functions.numeric import first_known
from ..operators import filters as L, scoring as S


@dataclass(frozen=True)
class ScreenConfig:
    top_n: int = 10
    currencies: list[str] = field(default_factory=lambda: ["all"])
    min_cap: float | None = None
    explicit_tickers: bool = False
    sector: str | None = None
    model: str = "quant"
    technical: bool | None = None


def scored_assets(assets: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Rows without errors, scored; ``assets`` holds stocks and funds in one table."""
    usable = L.without_errors(assets) if "errors" in assets.columns else assets
    return S.score_assets(usable, cfg.model, cfg.technical)


def filtered(scored: DataFrame, cfg: ScreenConfig) -> DataFrame:
    d = L.currency(scored, cfg.currencies)
    d = L.min_cap(d, L.default_min_cap(cfg.min_cap, cfg.explicit_tickers))
    return L.sector_prefix(d, cfg.sector)


def screen(assets: DataFrame, cfg: ScreenConfig, tie: str = "ord") -> DataFrame:
    """The best assets after all filters; ties keep universe order.  One lazy plan, top-k at the end."""
    return filtered(scored_assets(assets, cfg), cfg).orderBy(F.col("total").desc(), F.col(tie).asc()).limit(cfg.top_n)


def report_rows(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """Presentation rows: an explicit NULL check keeps a yield of 0.0."""
    dividend = first_known("dividend_yield", "yield") if "yield" in ranked.columns else F.col("dividend_yield")
    values = F.map_values("breakdown")
    return ranked.select(
        F.col(rank).alias("rank"), F.lower("asset_type").alias("asset_type"), "symbol", F.coalesce("name", F.lit("-")).alias("name"),
        F.coalesce("sector", F.lit("-")).alias("sector"), X.infer_region("symbol").alias("region"), F.col("price"), "daily_change",
        "return_1m", "return_12m", dividend.alias("dividend_yield"), F.bround("total", 2).alias("score"),
        F.array_join(F.transform(values, lambda v: F.bround(v, 0).cast("bigint").cast("string")), " / ").alias("breakdown"),
        X.top_why("rationale").alias("why"))


def session_labels(scored: DataFrame) -> DataFrame:
    """The sessions a result describes; distinct days, so the list stays small."""
    return scored.agg(F.array_sort(F.collect_set("session")).alias("sessions"))
