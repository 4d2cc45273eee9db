"""Text column functions: tickers, regions, rationale notes, compact money."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import MAX_RATE_GROWTH, col

# Listing suffixes per region.
EUROPE_SUFFIXES = ["DE", "F", "PA", "AS", "L", "MC", "MI", "SW", "ST", "CO", "HE", "OL", "BR"]
ASIA_SUFFIXES = ["T", "HK", "SI", "NS", "KS", "TW", "AX", "SS", "SZ"]

#: Fixed value: shape of a usable ticker.
TICKER_PATTERN = r"^[A-Z0-9.\-]+$"


def split_base(ticker: Column | str) -> Column:
    """Part before the last dot, upper-cased."""
    return F.regexp_extract(F.upper(col(ticker)), r"^(.*?)(?:\.([^.]*))?$", 1)


def split_suffix(ticker: Column | str) -> Column:
    """Part after the last dot, '' without one."""
    return F.regexp_extract(F.upper(col(ticker)), r"^(.*?)(?:\.([^.]*))?$", 2)


def infer_region(ticker: Column | str) -> Column:
    suffix = split_suffix(ticker)
    return (F.when(suffix.isin(EUROPE_SUFFIXES), "eu")
            .when(suffix.isin(ASIA_SUFFIXES), "asia").otherwise("us"))


def norm_symbol(ticker: Column | str) -> Column:
    """Share-class dots become dashes; trimmed and upper-cased."""
    return F.upper(F.translate(F.trim(col(ticker)), ".", "-"))


def is_ticker(ticker: Column | str) -> Column:
    return col(ticker).rlike(TICKER_PATTERN)


def nearest(x: Column, digits: int) -> Column:
    """The double rounded to no or one digit as C's printf does: by its exact binary value, ties to even.

    Java's formatter rounds the shortest decimal form and takes ties up, so texts are formatted after this.
    """
    if digits == 0:
        return F.rint(x)
    if digits != 1:
        return x
    a = F.abs(x)
    # ten times the fraction in units of 2**-59: exact from 2**-7 on, and less than that is far from a tie
    ten = ((a - F.floor(a)) * float(1 << 59)).cast("bigint") * 10
    tenths, rest = F.shiftright(ten, 59), ten.bitwiseAND(F.lit((1 << 59) - 1))
    up = (rest > 1 << 58) | ((rest == 1 << 58) & (tenths % 2 == 1))
    rounded = (F.floor(a).cast("double") * 10.0 + (tenths + F.when(up, 1).otherwise(0)).cast("double")) / 10.0
    return F.when(a < 1e14, F.when(x < 0, -rounded).otherwise(rounded)).otherwise(x)


def percent_text(v: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", nearest(col(v) * 100.0, digits))


def signed_percent_text(v: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f%%", nearest(col(v) * 100.0, digits))


def usd_text(v: Column | str) -> Column:
    x = col(v)
    return (F.when(F.abs(x) >= 1e9, F.format_string("$%.1fB", nearest(x / 1e9, 1)))
            .when(F.abs(x) >= 1e6, F.format_string("$%.0fM", nearest(x / 1e6, 0)))
            .otherwise(F.format_string("$%,.0f", x)))


def compact_text(v: Column | str) -> Column:
    x = col(v)
    m = F.abs(x)
    sign = F.when(x < 0, "-").otherwise("")
    body = (F.when(m >= 1e12, F.format_string("%.1fT", m / 1e12))
            .when(m >= 1e9, F.format_string("%.1fB", m / 1e9))
            .when(m >= 1e6, F.format_string("%.1fM", m / 1e6))
            .when(m >= 1e3, F.format_string("%.1fK", m / 1e3))
            .otherwise(F.format_string("%.0f", m)))
    return F.concat(sign, body)


def growth_note(growth: Column | str, cagr: Column | str) -> Column:
    """A yearly rate where the change is one, the two-year rate where the base is distorted."""
    g, c = col(growth), col(cagr)
    plain = F.format_string("earnings growth of %.1f%%", g * 100.0)
    with_rate = F.format_string(
        "earnings growth of %+.1f%% a year over 2 years (%+.1f%% in the latest year alone, "
        "inflated by an unusually low prior year)", c * 100.0, g * 100.0)
    labelled = F.concat(plain, F.lit(" (inflated by an unusually low prior year)"))
    return F.when(g <= MAX_RATE_GROWTH, plain).when(c.isNotNull(), with_rate).otherwise(labelled)


def notes(*parts: Column) -> Column:
    """Ordered rationale: NULL parts drop out."""
    return F.array_compact(F.array(*parts))


def top_why(rationale: Column | str, k: int = 3) -> Column:
    r = col(rationale)
    return F.when(F.size(r) > 0, F.array_join(F.slice(r, 1, k), "; ")).otherwise("-")


def breakdown_text(*parts: Column) -> Column:
    """Half-even rounding, as the report prints factor scores."""
    return F.array_join(F.array(*[F.bround(p, 0).cast("bigint").cast("string") for p in parts]), " / ")


# What counts as a camel-case piece of a name, and the signs that separate its words.
NAME_PIECE = r"([A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+)"
NAME_SIGNS = r"[/,&()]+"


def search_variants(name: Column | str) -> Column:
    """Up to three name queries: the whole name, its first word, the first camel-case piece."""
    n = col(name)
    first = F.get(F.filter(F.split(n, r"\s+"), lambda w: w != ""), F.lit(0))
    piece = F.get(F.regexp_extract_all(first, F.lit(NAME_PIECE), F.lit(1)), F.lit(0))
    raw = F.array(n, F.when(F.length(first) >= 4, first), F.when(F.length(piece) >= 4, piece))
    clean = F.transform(
        F.array_compact(raw),
        lambda q: F.rtrim(F.trim(F.regexp_replace(F.regexp_replace(q, NAME_SIGNS, " "), r"\s+", " ")), F.lit(".")),
    )
    return F.slice(F.array_distinct(F.filter(clean, lambda q: q != "")), 1, 3)
