"""Point-in-time evaluation: every asset at every snapshot under every variant in one plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.dates import months_to_days
from ..operators import asof as A, fundamentals as U, metrics as M, ranking as R, scoring as S, technicals as T
from ..session import stable

H6, H12 = months_to_days(6), months_to_days(12)


@dataclass(frozen=True)
class EvalConfig:
    lag_days: int = 60
    years: float = 5
    step_months: int = 3
    top_n: int = 10
    min_cap: float = 0.0
    clock: str = "period"  # or "filed"
    model: str = "quant"
    technical: bool | None = None
    enforce_cap: bool = True
    first_quarter: str | None = "2000-01-01"


@dataclass(frozen=True)
class Market:
    """The tables an evaluation reads."""

    prices: DataFrame
    sessions: DataFrame
    annual: DataFrame
    dividends: DataFrame
    earnings: DataFrame
    benchmark: DataFrame  # session, close


def dates_of(m: Market, cfg: EvalConfig) -> DataFrame:
    return A.snapshot_array(m.sessions, cfg.lag_days, cfg.years, cfg.step_months)


def price_rows(m: Market, cfg: EvalConfig, dates: DataFrame | None = None) -> DataFrame:
    """Price features and forward returns (r6, r12) per ticker and snapshot.

    The costly part of an evaluation: checkpoint it once when several clocks or models read it.
    """
    at = T.features_at(m.prices, dates_of(m, cfg) if dates is None else dates, (H6, H12))
    return at.withColumns({"r6": A.forward_return(F.col("price"), F.col(f"close_{H6}")),
                           "r12": A.forward_return(F.col("price"), F.col(f"close_{H12}"))}).drop(f"close_{H6}", f"close_{H12}")


def with_fundamentals(at: DataFrame, m: Market, cfg: EvalConfig) -> DataFrame:
    return U.historical_features(at, m.annual, m.dividends, m.earnings, cfg.lag_days, cfg.first_quarter, cfg.clock)


def snapshot_features(m: Market, cfg: EvalConfig, dates: DataFrame | None = None) -> DataFrame:
    """All features and forward returns per ticker and snapshot."""
    return with_fundamentals(price_rows(m, cfg, dates), m, cfg)


def choose_path(classic: DataFrame, filed: DataFrame, has_filings: DataFrame, key: str = "ticker") -> DataFrame:
    """Whole rows from the filing-date path for tickers with any filing, the fixed-lag path otherwise."""
    with_filing = has_filings.select(key).distinct()
    return filed.join(with_filing, key, "left_semi").unionByName(
        classic.join(with_filing, key, "left_anti"), allowMissingColumns=True)


def benchmark_returns(m: Market, dates: DataFrame) -> DataFrame:
    """b6, b12 per snapshot: the benchmark is one series, so the as-of join is a small one."""
    series = m.benchmark.select(F.lit("benchmark").alias("symbol"), "session", "close")
    grid = dates.select(F.explode("dates").alias("snapshot"))
    asked = grid.withColumn("h", F.explode(F.array(F.lit(0), F.lit(H6), F.lit(H12)))).select(
        F.lit("benchmark").alias("symbol"), F.date_add("snapshot", F.col("h")).alias("at"), "snapshot", "h")
    found = A.asof_close(asked.select("symbol", "at").distinct(), series, "symbol", "at")
    d = asked.join(found, ["symbol", "at"]).groupBy("snapshot").agg(
        *[F.max(F.when(F.col("h") == h, F.col("close"))).alias(f"c{h}") for h in (0, H6, H12)])
    return d.select("snapshot", A.forward_return(F.col("c0"), F.col(f"c{H6}")).alias("b6"),
                    A.forward_return(F.col("c0"), F.col(f"c{H12}")).alias("b12"))


def scored(features: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Cap filter, then the chosen model."""
    d = features if cfg.min_cap <= 0 else features.filter(F.col("market_cap") >= cfg.min_cap)
    tech = S.uses_technical(cfg.technical, cfg.model)
    return S.score_quant(d, tech, cfg.enforce_cap) if cfg.model == "quant" else S.score_classic(d, tech)


def with_benchmark(baskets: DataFrame, bench: DataFrame) -> DataFrame:
    # one row per snapshot date: a few hundred at most
    return baskets.join(F.broadcast(bench), "snapshot", "left")


def evaluate_snapshots(m: Market, cfg: EvalConfig, stocks: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """One row per snapshot: basket and benchmark returns of the top-N.  ``at`` reuses stored price rows."""
    dates = dates_of(m, cfg)
    f = snapshot_features(m, cfg, dates) if at is None else with_fundamentals(at, m, cfg)
    if stocks is not None:
        f = f.join(stocks, "ticker", "left_semi")
    picks = R.top_n(scored(f, cfg), ["snapshot"], cfg.top_n)
    return with_benchmark(M.basket_returns(picks, ["snapshot"]), benchmark_returns(m, dates))


def evaluation(m: Market, cfg: EvalConfig, stocks: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """Metrics of one run as a single row; no row when there is no snapshot."""
    rows = evaluate_snapshots(m, cfg, stocks, at).withColumn("run", F.lit("run")).drop("held")
    return M.evaluation_metrics(rows, ["run"]).drop("run")


# Messages of an evaluation that cannot be made.
EMPTY_UNIVERSE, NO_BENCHMARK, NO_HISTORY, NO_SNAPSHOT = "Empty universe", "Could not fetch benchmark %s", "No historical data available", "Not enough history for any snapshot"


def _observed(o: Observation) -> int:
    """The observed count; 0 where the adaptive plan has replaced the observed part by an empty relation, which then has no figures."""
    try:
        return o.get.get("n", 0)
    except Py4JJavaError:
        return 0


def diagnosed(m: Market, cfg: EvalConfig, stocks: DataFrame, benchmark: str) -> DataFrame:
    """``evaluation`` with an ``error`` column: its metrics, or one row of nulls that says why there are none.

    What the run has read is observed while it runs: the counts of assets, benchmark closes and bars come
    back with the stored result, without a second pass. The first reason that applies is named.
    """
    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("universe", "benchmark", "bars")}
    watched = lambda df, name: df.observe(seen[name], F.count("*").alias("n"))
    run = replace(m, prices=watched(m.prices.join(stocks, "ticker", "left_semi"), "bars"), benchmark=watched(m.benchmark, "benchmark"))
    result = stable(evaluation(run, cfg, watched(stocks, "universe")))
    rows = {name: _observed(o) for name, o in seen.items()}
    if not result.isEmpty() and rows["benchmark"]:
        return result.withColumn("error", F.lit(None).cast("string"))
    # a part of the plan that needed no running after an empty input has nothing to report
    found = lambda name, df: rows[name] > 0 or not df.isEmpty()
    error = (EMPTY_UNIVERSE if not found("universe", stocks) else NO_BENCHMARK % benchmark if not found("benchmark", m.benchmark)
             else NO_HISTORY if not found("bars", m.prices.join(stocks, "ticker", "left_semi")) else NO_SNAPSHOT)
    return result.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema], F.lit(error).alias("error"))


Strategy = Callable[[DataFrame], DataFrame]


def top_strategy(n: int) -> Strategy:
    """Hold the top-N of every review: a frame transform, usable with ``DataFrame.transform``."""
    return lambda ranked: R.top_n(ranked, ["snapshot"], n)


def evaluate_strategy(ranked: DataFrame, bench: DataFrame, strategy: Strategy) -> DataFrame:
    """``strategy`` maps the scored rows to the held rows."""
    rows = with_benchmark(M.basket_returns(ranked.transform(strategy), ["snapshot"]), bench)
    return M.evaluation_metrics(rows.withColumn("run", F.lit("run")), ["run"]).drop("run")


def n_sweep(ranked: DataFrame, bench: DataFrame, ns: list[int]) -> DataFrame:
    """Metrics per cut-off; one ranking serves all of them."""
    picks = R.top_n_many(ranked, ["snapshot"], ns)
    return M.evaluation_metrics(with_benchmark(M.basket_returns(picks, ["n", "snapshot"]), bench), ["n"])


def hysteresis_sweep(ranked: DataFrame, bench: DataFrame, dates: DataFrame, bands: list[tuple[int, int, int]]) -> DataFrame:
    """Metrics per band; a review with nothing held is skipped.

    ``ranked`` is read twice (ranks, returns): hand in a checkpointed table.
    """
    group = ["enter", "exit", "confirm"]
    top = R.top_n(ranked, ["snapshot"], max(b[1] for b in bands))
    held = M.hysteresis(top.select("snapshot", "ticker", "rank"), [], bands, dates)
    picks = held.join(ranked.select("snapshot", "ticker", "r6", "r12"), ["snapshot", "ticker"], "left")
    return M.evaluation_metrics(with_benchmark(M.basket_returns(picks, [*group, "snapshot"]), bench), group)


def variant_sweep(factors: DataFrame, bench: DataFrame, variants: list[dict], ns: list[int]) -> DataFrame:
    """Metrics per (variant, n) over rows that already carry factor scores."""
    s = S.score_variants(factors.select("ticker", "snapshot", "r6", "r12", *[f"f_{f}" for f in S.QUANT_WEIGHTS],
                                        *(["candidates"] if "candidates" in factors.columns else [])), variants)
    picks = R.top_n_many(s, ["variant", "snapshot"], ns)
    rows = with_benchmark(M.basket_returns(picks, ["variant", "n", "snapshot"]), bench)
    return M.evaluation_metrics(rows, ["variant", "n"])
