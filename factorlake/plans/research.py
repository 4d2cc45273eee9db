"""Research sweeps: information coefficients, relative scores, tilts, pools, source comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric as N
from ..operators import asof as A, fundamentals as U, metrics as M, ranking as R, scoring as S
from ..operators.technicals import momentum_12_1
from ..session import stable
from .evaluate import with_benchmark


def with_health(features: DataFrame) -> DataFrame:
    """Adds Piotroski and Altman structs and the candidate score map from the as-of periods."""
    cur, prev = A.n_back(F.col("_visible"), 0), A.n_back(F.col("_visible"), 1)
    return (features.withColumn("_cur", cur).withColumn("_prev", prev)
            .withColumn("pio", U.piotroski(F.col("_cur"), F.col("_prev"))).withColumn("alt", U.altman(F.col("_cur")))
            .withColumn("candidates", S.candidate_scores(F.col("_cur"), F.col("_prev"))).drop("_cur", "_prev"))


def metric_columns() -> dict[str, Column]:
    """Metric name -> expression over scored feature rows (six scores, raw values, health, nine checks)."""
    c = F.col
    neg = lambda x: -x
    out: dict[str, Column] = {f"F_{f}": c(f"f_{f}") for f in ("value", "growth", "profitability", "eps_revisions")}
    out["F_momentum"] = S.quant_momentum()
    out["F_total"] = c("total")
    out.update({
        "pe": neg(c("trailing_pe")), "pb": neg(c("price_to_book")),
        "fcf_yield": F.when(c("market_cap") != 0, N.ratio("free_cashflow", "market_cap")),
        "roe": c("return_on_equity"), "profit_margin": c("profit_margin"), "earnings_growth": c("earnings_growth"),
        "revenue_growth": c("revenue_growth"), "eps_surprise": c("eps_surprise"), "eps_acceleration": c("eps_acceleration"),
        "peg_derived_NEG": F.when((c("trailing_pe") > 0) & (c("earnings_growth") > 0), neg(N.ratio("trailing_pe", "earnings_growth"))),
        "return_12m": c("return_12m"),
        "return_12m_ex_1m": F.when(c("return_1m").isNotNull() & (c("return_1m") > -0.99), momentum_12_1(c("return_12m"), c("return_1m"))),
        "return_6m": c("return_6m"), "return_3m": c("return_3m"), "return_1m_REV": neg(c("return_1m")),
        "price_vs_sma200": c("price_vs_sma200"), "sma200_slope": c("sma200_slope"), "pct_off_52w_high": c("pct_off_high"),
        "volatility_LOW": neg(c("volatility_research")), "rsi_14": c("rsi_14"),
        "piotroski": c("pio.score").cast("double"), "altman_z": c("alt.z_score"),
    })
    out.update({f"pio_{k}": c(f"pio.{k}").cast("int").cast("double") for k in U.PIOTROSKI_CHECKS})
    return out


def unpivot_metrics(scored: DataFrame, metrics: dict[str, Column], y: str = "r6") -> DataFrame:
    """Long (ticker, snapshot, metric, x, y); unknown pairs drop out before any shuffle."""
    items = F.array(*[F.struct(F.lit(n).alias("metric"), N.finite(e.cast("double")).alias("x")) for n, e in metrics.items()])
    d = scored.select("ticker", "snapshot", F.col(y).alias("y"), F.explode(items).alias("m"))
    return d.select("ticker", "snapshot", "m.metric", "m.x", "y").filter("x IS NOT NULL AND y IS NOT NULL")


def factor_ic(scored: DataFrame, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Rank correlation with the six-month forward return per snapshot and metric."""
    long = stable(unpivot_metrics(scored, metrics or metric_columns()))
    return R.spearman(long, ["snapshot", "metric"], "x", "y", "ticker")


def candidate_ic(scored: DataFrame) -> DataFrame:
    long = scored.select("ticker", "snapshot", F.col("r6").alias("y"), F.explode("candidates").alias("metric", "x"))
    long = stable(long.filter("x IS NOT NULL AND y IS NOT NULL"))
    return R.spearman(long, ["snapshot", "metric"], "x", "y", "ticker")


#: raw value, higher is better
RELATIVE_INPUTS: dict[str, bool] = {"pe": False, "pb": False, "peg": False, "fcf": True, "eg": True, "rg": True, "roe": True,
                                    "roa": True, "mg": True, "pvs": True, "r12": True, "sl": True, "es": True}


def relative_scores(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Totals from cross-sectional percentiles instead of fixed thresholds, same sub-weights and cap.

    ``features`` is read twice: hand in a checkpointed table.
    """
    c = F.col
    raw = {"pe": N.non_negative("trailing_pe"), "pb": N.non_negative("price_to_book"), "peg": N.non_negative("peg_ratio"),
           "fcf": S.fcf_yield(), "eg": c("earnings_growth"), "rg": c("revenue_growth"), "roe": c("return_on_equity"),
           "roa": c("return_on_assets"), "mg": c("profit_margin"), "pvs": c("price_vs_sma200"),
           "r12": momentum_12_1(c("return_12m"), c("return_1m")), "sl": c("sma200_slope"), "es": c("eps_surprise")}
    items = F.array(*[F.struct(F.lit(n).alias("metric"), N.finite(e).alias("x")) for n, e in raw.items()])
    long = features.select("ticker", "snapshot", F.explode(items).alias("m")).select("ticker", "snapshot", "m.metric", "m.x").filter("x IS NOT NULL")
    ranked = R.percentile_score(stable(long), ["snapshot", "metric"], "x", "ticker", "p")
    low = [k for k, up in RELATIVE_INPUTS.items() if not up]
    ranked = ranked.withColumn("p", F.when(F.col("metric").isin(low), F.lit(100.0) - F.col("p")).otherwise(F.col("p")))
    # a metric known for one asset only is neutral in either direction
    wide = ranked.groupBy("ticker", "snapshot").agg(*[F.max(F.when(c("metric") == n, c("p"))).alias(f"p_{n}") for n in raw])
    d = features.join(wide, ["ticker", "snapshot"], "left")
    p = lambda n: F.coalesce(c(f"p_{n}"), F.lit(50.0))
    mom = S.mix((p("pvs"), 0.35), (p("r12"), 0.40), (p("sl"), 0.25))
    d = (d.withColumn("f_value", S.mix((p("pe"), 0.35), (p("pb"), 0.20), (p("peg"), 0.25), (p("fcf"), 0.20)))
         .withColumn("f_growth", S.mix((p("eg"), 0.55), (p("rg"), 0.45)))
         .withColumn("f_profitability", S.mix((p("roe"), 0.30), (p("mg"), 0.25), (p("roa"), 0.15), (S.improvement(), 0.30)))
         .withColumn("f_momentum", S.mix((mom, 0.70), (S.technical(), 0.30)))
         .withColumn("f_eps_revisions", p("es")).withColumn("f_asset_growth", S.quant_asset_growth()))
    total = S.weighted_total(weights or S.QUANT_WEIGHTS, list(weights or S.QUANT_WEIGHTS))
    return d.withColumn("total", S.capped(total, S.disqualified("full")))


def tilt_variants(candidates: list[str], tilts: list[float]) -> list[dict]:
    base = [S.variant("baseline", tilt=0.0, candidate="")]
    return base + [S.variant(f"{c}@{t:.0%}", tilt=t, candidate=c) for c in candidates for t in tilts]


def known_at_snapshot(features: DataFrame, anchor: str = "ni", min_rows: int = 2) -> DataFrame:
    """Only assets with the anchor fact known, only snapshots with at least ``min_rows`` of them.

    The count is a small per-date table joined back, not a window over the whole cross-section.
    """
    d = features.filter(F.col(anchor).isNotNull())
    enough = d.groupBy("snapshot").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select("snapshot")
    return d.join(F.broadcast(enough), "snapshot", "left_semi")


def pool_sweep(scored: DataFrame, membership: DataFrame, bench: DataFrame, ns: list[int]) -> DataFrame:
    """Metrics per (pool, n): one scored table, a bridge (pool, ticker) says who belongs where."""
    d = scored.select("ticker", "snapshot", "total", "r6", "r12").join(membership, "ticker")
    picks = R.top_n_many(d, ["pool", "snapshot"], ns)
    rows = with_benchmark(M.basket_returns(picks, ["pool", "n", "snapshot"]), bench)
    return M.evaluation_metrics(rows, ["pool", "n"])


# ---- source comparison -------------------------------------------------------------------------

def compare_scores(a: DataFrame, b: DataFrame, key: str = "ticker") -> DataFrame:
    """Full outer comparison of two scored tables with both ranks (position by total, then ticker)."""
    def ranked(d: DataFrame, side: str) -> DataFrame:
        neg = stable(d.select(key, F.col("total"), (-F.col("total")).alias("_neg"), F.lit(1).alias("_all")))
        p = R.positions(neg, ["_all"], "_neg", key)
        return p.select(key, F.col("total").alias(f"score_{side}"), F.col("_ordinal").alias(f"rank_{side}"))
    d = ranked(a, "a").join(ranked(b, "b"), key, "full_outer")
    both = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    state = F.when(both, "common").when(F.col("score_a").isNotNull(), "only_a").otherwise("only_b")
    return d.withColumn("side", state).withColumn("diff", F.when(both, F.abs(F.col("score_a") - F.col("score_b"))))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("side") == "common").alias("common_tickers"), F.count_if(F.col("side") == "only_a").alias("a_only"),
                        F.count_if(F.col("side") == "only_b").alias("b_only"), F.avg("diff").alias("avg_score_diff"), F.max("diff").alias("max_score_diff"))


def largest_diffs(compared: DataFrame, k: int = 10, key: str = "ticker") -> DataFrame:
    return compared.filter(F.col("side") == "common").orderBy(F.col("diff").desc(), key).limit(k)


def unpivot_fields(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    return df.select(*keys, F.explode(items).alias("_f")).select(*keys, "_f.field", "_f.value")


def field_coverage(df: DataFrame, fields: list[str], group: list[str] = ["asset_type"]) -> DataFrame:
    """Percent of known values per field."""
    long = unpivot_fields(df, fields, group)
    return long.groupBy(*group, "field").agg((F.avg(F.col("value").isNotNull().cast("int")) * 100.0).alias("coverage"))


def field_accuracy(a: DataFrame, b: DataFrame, fields: list[str], key: str = "ticker") -> DataFrame:
    """Relative gap per field over common tickers (absolute for tiny values, 100 % when one side is missing)."""
    j = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("double").alias("x"), F.col(f"b_{f}").cast("double").alias("y")) for f in fields])
    d = j.select(F.explode(items).alias("m")).select("m.*").filter("x IS NOT NULL OR y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    gap = F.when(x.isNull() | y.isNull(), 1.0).when(F.abs(x) > 0.01, N.ratio(F.abs(x - y), F.abs(x))).otherwise(F.abs(x - y))
    d = d.withColumn("gap", gap)
    return d.groupBy("field").agg((F.avg("gap") * 100.0).alias("avg_rel_diff"), (F.max("gap") * 100.0).alias("max_rel_diff"),
                                  F.count_if(F.col("gap") >= 1.0).alias("missing_count"))
