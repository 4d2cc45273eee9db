"""Distributed ranks, hysteresis and measures against brute force."""

import datetime as dt
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake import stable
from factorlake.operators import metrics as M, ranking as R
from factorlake.session import shared_folder


def cross_section(spark, seed, hot):
    rng = random.Random(seed)
    rows = []
    for g in ("a", "b"):
        for k in range(300):
            v = 50.0 if rng.random() < hot else rng.choice([rng.uniform(-1e-3, 1e-3), rng.uniform(-90, 90), 0.0, -0.0, rng.uniform(1e6, 1e9)])
            rows.append((g, k * 40_000, v, rng.gauss(0, 1) if rng.random() > 0.1 else None))
    return rows, stable(spark.createDataFrame(rows, "g string, k bigint, v double, y double"))


@pytest.mark.parametrize("hot", [0.0, 0.4])
@pytest.mark.parametrize("as_text", [False, True])
def test_positions_match_pandas(spark, hot, as_text):
    rows, d = cross_section(spark, 1, hot)
    want = pd.DataFrame(rows, columns=["g", "k", "v", "y"])
    if as_text:
        d, want["k"] = d.withColumn("k", F.concat(F.lit("t"), F.col("k"))), "t" + want["k"].astype(str)
    got = R.positions(d, ["g"], "v", "k").toPandas()
    want["v"] = want["v"] + 0.0
    want["avg"] = want.groupby("g")["v"].rank()
    want = want.sort_values(["g", "v", "k"])
    want["ord"] = want.groupby("g").cumcount() + 1
    m = got.merge(want, on=["g", "k"])
    assert (m["_ordinal"] == m["ord"]).all() and ((m["_below"] + (m["_ties"] + 1) / 2) == m["avg"]).all() and (m["_size"] == 300).all()


def test_spearman_matches_pandas(spark):
    rows, d = cross_section(spark, 2, 0.3)
    want = pd.DataFrame(rows, columns=["g", "k", "v", "y"]).dropna()
    got = {r["g"]: (r["pairs"], r["ic"]) for r in R.spearman(d, ["g"], "v", "y", "k").collect()}
    for g, p in want.groupby("g"):
        assert got[g][0] == len(p) and got[g][1] == pytest.approx((p["v"] + 0.0).rank().corr(p["y"].rank()), abs=1e-12)
    flat = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(9)] + [("b", i, float(i), float(i)) for i in range(4)], "g string, k bigint, v double, y double")
    assert R.spearman(flat, ["g"], "v", "y", "k").count() == 0


def test_percentile_score_is_ordinal(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 9.0), ("a", 4, None), ("b", 1, 7.0)], "g string, k bigint, v double")
    got = {(r["g"], r["k"]): r["p"] for r in R.percentile_score(d, ["g"], "v", "k", "p").collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 50.0, ("a", 3): 100.0, ("b", 1): 50.0}


def loop_hysteresis(rankings, enter, exit_, confirm):
    misses, out = {}, []
    for ranking in rankings:
        top = set(ranking[:exit_])
        for name in list(misses):
            misses[name] = 0 if name in top else misses[name] + 1
            if misses[name] >= confirm:
                del misses[name]
        for name in ranking[:enter]:
            misses.setdefault(name, 0)
        out.append(sorted(misses))
    return out


def test_hysteresis_matches_loop(spark):
    rng = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=90 * i) for i in range(14)]
    names = list(range(12))
    rankings = [rng.sample(names, len(names)) for _ in days]
    rows = [(d, n, i + 1) for d, r in zip(days, rankings) for i, n in enumerate(r)]
    ranked = spark.createDataFrame(rows, "snapshot date, ticker bigint, rank bigint")
    dates = spark.createDataFrame([(days,)], "dates array<date>")
    bands = [(e, x, c) for e in (1, 3, 5) for x in (5, 8) for c in (1, 2, 3)]
    got = M.hysteresis(ranked, [], bands, dates).collect()
    for e, x, c in bands:
        want = loop_hysteresis(rankings, e, x, c)
        for i, d in enumerate(days):
            assert sorted(r["ticker"] for r in got if (r["enter"], r["exit"], r["confirm"], r["snapshot"]) == (e, x, c, d)) == want[i]
    with pytest.raises(ValueError):
        M.hysteresis(ranked, [], [(6, 5, 1)], dates)


def snapshots(spark, rows):
    data = [("v", dt.date(2020, 1, 1) + dt.timedelta(days=90 * i), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "run string, snapshot date, r6 double, r12 double, b6 double, b12 double")


def test_documented_alpha(spark):
    """15 chained snapshots, 248.57 % against 124.54 %: 6.04 % a year."""
    r, b = 3.4857 ** (1 / 15) - 1, 2.2454 ** (1 / 15) - 1
    m = M.evaluation_metrics(snapshots(spark, [(r, None, b, None)] * 15), ["run"]).first()
    assert m["cumulative_return"] == pytest.approx(2.4857, abs=1e-9) and m["benchmark_return"] == pytest.approx(1.2454, abs=1e-9)
    assert m["alpha"] == pytest.approx((3.4857 / 2.2454) ** (1 / 7.5) - 1, abs=1e-12) and round(m["alpha"] * 100, 2) == 6.04
    assert m["n12"] == 0 and m["win_rate_12m"] == 0.0 and m["win_rate_6m"] == 1.0 and m["max_drawdown"] == 0.0


def test_metrics_skip_unpaired_rows(spark):
    m = M.evaluation_metrics(snapshots(spark, [(0.10, 0.2, 0.05, 0.1), (-0.5, 0.1, 0.05, 0.3), (0.9, None, None, None), (0.2, 0.2, 0.3, None)]), ["run"]).first()
    assert (m["snapshots"], m["n6"], m["n12"]) == (4, 3, 2)
    assert m["cumulative_return"] == pytest.approx(1.1 * 0.5 * 1.2 - 1) and m["max_drawdown"] == pytest.approx(0.5)
    r = np.array([0.10, -0.5, 0.2])
    assert m["sharpe"] == pytest.approx((r - 0.0225).mean() / r.std(ddof=1) * math.sqrt(2))
    assert m["win_rate_6m"] == pytest.approx(1 / 3) and m["win_rate_12m"] == 0.5
    lone = M.evaluation_metrics(snapshots(spark, [(-1.0, None, -1.0, None)]), ["run"]).first()
    assert lone["sharpe"] == 0.0 and lone["alpha"] == 0.0 and lone["cumulative_return"] == -1.0


def test_curve_metrics(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    c = spark.createDataFrame([("x", d, v) for d, v in zip(days, [1.0, 1.1, 0.99, 1.2])], "curve string, session date, equity double")
    m = M.curve_metrics(c, ["curve"]).first()
    r = np.array([0.1, -0.1, 1.2 / 0.99 - 1])
    assert m["max_drawdown"] == pytest.approx(-0.1) and m["total_return"] == pytest.approx(0.2)
    assert m["vol"] == pytest.approx(r.std(ddof=1) * math.sqrt(252)) and m["cagr"] == pytest.approx(1.2 ** (365.25 / 3) - 1)


def test_top_n_breaks_ties_by_ticker_and_is_limited_early(spark):
    d = spark.createDataFrame([("s", 3, 1.0), ("s", 1, 1.0), ("s", 2, 2.0)], "snapshot string, ticker bigint, total double")
    t = R.top_n(d, ["snapshot"], 2)
    assert [(r["rank"], r["ticker"]) for r in t.orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert "WindowGroupLimit" in t._jdf.queryExecution().executedPlan().toString()
    many = R.top_n_many(d, ["snapshot"], [1, 3])
    assert sorted((r["n"], r["ticker"]) for r in many.collect()) == [(1, 2), (3, 1), (3, 2), (3, 3)]


def test_value_ranks_take_one_write_and_spread_hot_values(spark):
    rows, d = cross_section(spark, 4, 0.4)
    tables = lambda: len(os.listdir(f"{shared_folder(spark)}/tables"))
    before = tables()
    R.spearman(d, ["g"], "v", "y", "k")
    assert tables() == before + 1
    ranks = R.value_ranks(d, ["g"], ["v", "y"])
    assert ranks.count() == sum(len({r[i] + 0.0 for r in rows if r[0] == g and r[i] is not None}) for g in "ab" for i in (2, 3))
    want = pd.DataFrame(rows, columns=["g", "k", "v", "y"])
    want["r"] = (want["v"] + 0.0).groupby(want["g"]).rank()
    got = R.average_rank(d, ["g"], "v", "k", "r").toPandas().merge(want, on=["g", "k"])
    assert len(got) == len(want) and (got["r_x"] == got["r_y"]).all()
