"""Null-safe numeric column functions.  No I/O, no UDFs: everything stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: annual risk-free rate of the ratio helpers.
RISK_FREE = 0.045
#: Fixed value: growth above this is a base effect, not a rate.
MAX_RATE_GROWTH = 1.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and the infinities become NULL; everything else is kept, 0.0 included."""
    v = col(c)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def finite_number(c: Column | str) -> Column:
    """Text to finite number; anything unparsable (``true`` included) is NULL."""
    return finite(col(c).cast("string").try_cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, NULL on a NULL or zero denominator (ANSI mode raises otherwise)."""
    return F.try_divide(col(num), col(den))


def ratio_pos(num: Column | str, den: Column | str) -> Column:
    """``num / den`` only where the denominator is positive."""
    d = col(den)
    return F.when(d > 0, F.try_divide(col(num), d))


def linear(c: Column | str, best: float, worst: float, default: float = 50.0) -> Column:
    """``best`` maps to 100, ``worst`` to 0, clamped; missing or non-finite gives ``default``."""
    v = col(c)
    if best == worst:
        return F.lit(float(default))
    score = (v - F.lit(float(worst))) / F.lit(float(best) - float(worst)) * F.lit(100.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    known = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(known, clamped).otherwise(F.lit(float(default)))


def non_negative(c: Column | str) -> Column:
    """A negative multiple means losses or negative equity: missing, not cheap."""
    v = col(c)
    return F.when(v >= 0, v)


def pct_change(cur: Column | str, prev: Column | str) -> Column:
    c, p = col(cur), col(prev)
    return F.try_divide(c - p, F.abs(p))


def cagr_2y(cur: Column | str, two_back: Column | str) -> Column:
    c, b = col(cur), col(two_back)
    return F.when((c > 0) & (b > 0), F.sqrt(F.try_divide(c, b)) - 1.0)


def peg(pe: Column | str, growth: Column | str) -> Column:
    p, g = col(pe), col(growth)
    ok = (p > 0) & (g > 0) & (g <= MAX_RATE_GROWTH)
    return F.when(ok, F.try_divide(p, g * 100.0))


def eps_acceleration(eps: Column | str, prev: Column | str, prev2: Column | str) -> Column:
    return pct_change(eps, prev) - pct_change(prev, prev2)


def sanitize_yield(c: Column | str) -> Column:
    v = finite(c)
    return F.when(v > 1.0, v / 100.0).otherwise(v)


def share_norm(c: Column | str) -> Column:
    """Shares tagged as percent (above 1.5, at most 100) are brought to fractions."""
    v = col(c)
    return F.when((v > 1.5) & (v <= 100.0), v / 100.0).otherwise(v)


def log10_positive(c: Column | str) -> Column:
    v = col(c)
    return F.when(v > 0, F.log10(v))


def sharpe_proxy(ret_12m: Column | str, vol: Column | str) -> Column:
    r, v = col(ret_12m), col(vol)
    return F.when(v > 0, F.try_divide(r - RISK_FREE, v))


def first_known(*cols: Column | str) -> Column:
    return F.coalesce(*[col(c) for c in cols])


def margin_improving(gp, rev, gp_prev, rev_prev) -> Column:
    """Strictly better margin than the year before; NULL when either side is unknown."""
    ok = (col(rev) > 0) & (col(rev_prev) > 0)
    return F.when(ok, F.try_divide(col(gp), col(rev)) > F.try_divide(col(gp_prev), col(rev_prev)))


def roa_improving(ni, assets, ni_prev, assets_prev) -> Column:
    return margin_improving(ni, assets, ni_prev, assets_prev)


def shift_weight(weights: dict[str, float], factor: str, delta: float) -> dict[str, float]:
    """Move one weight by ``delta`` and rescale the others so that the sum is kept."""
    moved = weights[factor] + delta
    if not 0.01 < moved < 0.99:
        raise ValueError(f"weight of {factor} leaves its range: {moved}")
    scale = (1.0 - moved) / (1.0 - weights[factor])
    return {k: (moved if k == factor else v * scale) for k, v in weights.items()}


def true_count(*flags: Column) -> Column:
    """How many of the flags hold (NULL counts as not held)."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.when(flag, 1).otherwise(0)
    return total
