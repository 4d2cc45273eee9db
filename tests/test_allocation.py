"""Closed-form allocation rules against plain day-by-day loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import allocation as AL
from factorlake.plans import allocation as PA


def make_panel(spark, names, days, seed):
    rng = np.random.default_rng(seed)
    start = dt.date(2020, 1, 1)
    dates = [start + dt.timedelta(days=i) for i in range(days)]
    closes = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.01, (days, len(names))), axis=0))
    rows = [(n, d, float(closes[i, j])) for j, n in enumerate(names) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "instrument string, session date, close double"), dates, closes


def loop_curve(dates, closes, targets, start=None):
    """(equity, turnover, exposure) with weights decided at day i-1, traded after day i's return; 10 bp on turnover."""
    r = np.vstack([np.zeros(closes.shape[1]), closes[1:] / closes[:-1] - 1])
    w, eq, out = np.zeros(closes.shape[1]) if start is None else np.array(start), 1.0, {dates[0]: (1.0, None, None)}
    for i in range(1, len(dates)):
        turn = None
        port = float((w * r[i]).sum())
        if 1 + port > 0:
            w = w * (1 + r[i]) / (1 + port)
        if dates[i - 1] in targets:
            turn = np.abs(targets[dates[i - 1]] - w).sum()
            port -= turn * 0.001
            w = targets[dates[i - 1]].copy()
        eq *= 1 + port
        out[dates[i]] = (eq, turn, w.sum())
    return out


def test_equity_curve_matches_loop(spark):
    names = ["A", "B", "C"]
    panel, dates, closes = make_panel(spark, names, 130, 1)
    rng = np.random.default_rng(2)
    ends = [d for i, d in enumerate(dates) if i + 1 == len(dates) or dates[i + 1].month != d.month]
    targets = {d: rng.dirichlet(np.ones(3)) * 0.8 for d in ends}
    rows = [("s", d, n, float(w)) for d, ws in targets.items() for n, w in zip(names, ws)]
    t = spark.createDataFrame(rows, "strategy string, decided date, instrument string, weight double")
    for start in (None, {"A": 0.6, "B": 0.4, "C": 0.0}):
        got = {r["session"]: r for r in AL.equity_curve(panel, t, ["strategy"], "instrument", start).collect()}
        want = loop_curve(dates, closes, targets, start and list(start.values()))
        assert sorted(got) == dates
        for d, (equity, turnover, exposure) in want.items():
            assert got[d]["equity"] == pytest.approx(equity, rel=1e-10)
            assert got[d]["turnover"] == (None if turnover is None else pytest.approx(turnover, rel=1e-9))
            assert got[d]["exposure"] == (None if exposure is None else pytest.approx(exposure, rel=1e-9))


def test_late_instruments_return_zero_until_their_first_close(spark):
    names = ["A", "B"]
    panel, dates, closes = make_panel(spark, names, 100, 7)
    late = panel.filter((F.col("instrument") == "A") | (F.col("session") >= dates[40]))
    filled = closes.copy()
    filled[:40, 1] = closes[40, 1]
    ends = [d for i, d in enumerate(dates) if i + 1 == len(dates) or dates[i + 1].month != d.month]
    t = AL.overlay_targets(late, "instrument", "A", "B")
    assert sorted({r["decided"] for r in t.collect()}) == ends
    got = {r["session"]: r["equity"] for r in AL.equity_curve(late, t.withColumn("s", F.lit(1)), ["s"], "instrument", {"A": 0.6, "B": 0.4}).collect()}
    want = loop_curve(dates, filled, {d: np.array([0.6, 0.4]) for d in ends}, [0.6, 0.4])
    assert [got[d] for d in dates] == pytest.approx([want[d][0] for d in dates], rel=1e-10)
    r = np.vstack([np.zeros(2), filled[1:] / filled[:-1] - 1])
    equal = {x["session"]: x["equity"] for x in AL.equal_weight_curve(late, "instrument").collect()}
    assert [equal[d] for d in dates] == pytest.approx(list(np.cumprod(1 + r.mean(axis=1))), rel=1e-10)


def test_cap_weights_redistributes(spark):
    d = spark.createDataFrame([([0.6, 0.2, 0.1, 0.1],), ([0.1, 0.1],), ([0.0, 0.0],)], "w array<double>")
    a, b, z = [r[0] for r in d.select(AL.cap_weights(F.col("w"))).collect()]
    assert max(a) <= 0.25 + 1e-12 and sum(a) == pytest.approx(1.0)
    assert b == pytest.approx([0.1, 0.1]) and z == [0.0, 0.0]


def test_grid_targets_match_covariance_form(spark):
    names = [f"I{i}" for i in range(5)]
    panel, dates, closes = make_panel(spark, names, 340, 3)
    got = PA.grid_targets(panel, "instrument", [6], [0.10]).collect()
    r = np.vstack([np.zeros(5), closes[1:] / closes[:-1] - 1])
    seen = 0
    for d in sorted({x["decided"] for x in got}):
        i = dates.index(d)
        w = {x["instrument"]: x["weight"] for x in got if x["decided"] == d}
        up = np.array([i + 1 >= 149 and closes[i - 21, j] / closes[i - 147, j] - 1 > 0 for j in range(5)]) if i >= 147 else np.zeros(5, bool)
        win = r[i - 62:i + 1]
        vol = win.std(axis=0, ddof=1) * np.sqrt(252)
        want = np.zeros(5)
        if up.any():
            inv = np.where(up, 1 / vol, 0)
            want = inv / inv.sum()
            cov = np.cov(win.T, ddof=1) * 252
            want = want * min(0.10 / np.sqrt(want @ cov @ want), 1)
            for _ in range(5):
                over = want > 0.25
                if not over.any():
                    break
                ex = (want[over] - 0.25).sum()
                want[over] = 0.25
                room = (want < 0.25) & (want > 0)
                if room.any() and ex > 0:
                    want[room] += ex * want[room] / want[room].sum()
            if want.sum() > 1:
                want = want / want.sum()
            seen += 1
        assert [w[n] for n in names] == pytest.approx(list(want), abs=1e-9)
    assert seen > 3


def test_rebalance_days_and_trend(spark):
    panel, dates, closes = make_panel(spark, ["A"], 320, 5)
    rows = AL.trend_flag(AL.rebalance_flag(panel, ["instrument"]), ["instrument"], 12, 1).orderBy("session").collect()
    for i, x in enumerate(rows):
        assert x["rebalance"] == (i + 1 == len(rows) or dates[i + 1].month != dates[i].month)
        want = i + 1 >= 275 and closes[i - 21, 0] / closes[i - 273, 0] - 1 > 0
        assert x["trending"] == bool(want)


def test_overlay_rotates_to_bonds(spark):
    days = 400
    start = dt.date(2020, 1, 1)
    rows = [("EQ", start + dt.timedelta(days=i), 200.0 - 0.2 * i) for i in range(days)] + [("BD", start + dt.timedelta(days=i), 100.0 + 0.1 * i) for i in range(days)]
    p = spark.createDataFrame(rows, "instrument string, session date, close double")
    last = AL.overlay_targets(p, "instrument", "EQ", "BD").orderBy(F.col("decided").desc(), "instrument").limit(2).collect()
    assert [(x["instrument"], x["weight"]) for x in last] == [("BD", 1.0), ("EQ", 0.0)]
    cash = AL.overlay_targets(p, "instrument", "EQ", "BD", rotate=False).orderBy(F.col("decided").desc(), "instrument").limit(2).collect()
    assert [(x["instrument"], x["weight"]) for x in cash] == [("BD", 0.4), ("EQ", 0.0)]
