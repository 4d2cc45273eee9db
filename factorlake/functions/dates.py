"""Calendar column functions: reporting quarters, snapshot dates, session clocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import col

#: The exchange clock that closes a daily bar, and the earliest usable quarter.
EXCHANGE_ZONE = "America/New_York"
CLOSE_HOUR = 16
FIRST_QUARTER = "2000-01-01"


def quarter_end(c: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(col(c), "quarter"), 2))


def prev_quarter_end(c: Column | str) -> Column:
    return F.date_sub(F.trunc(col(c), "quarter"), 1)


def latest_available_quarter(snapshot: Column | str, lag_days: int = 60, first: str | None = FIRST_QUARTER) -> Column:
    """Last quarter end whose report is assumed public ``lag_days`` later."""
    cutoff = F.date_sub(col(snapshot), lag_days)
    q = F.when(quarter_end(cutoff) <= cutoff, quarter_end(cutoff)).otherwise(prev_quarter_end(cutoff))
    return q if first is None else F.when(cutoff >= F.lit(first).cast("date"), q)


def months_to_days(months: int) -> int:
    """Forward horizons count 30.5 days a month, rounded down."""
    return int(30.5 * months)


def snapshot_dates(end: Column, start: Column, step_months: int = 3) -> Column:
    """Ascending dates stepping back from ``end`` by whole months while ``>= start``.

    The step is taken from the previous date, so a day clamped once stays clamped
    (31, 29, 29): a plain month sequence would jump back to 31.
    """
    if step_months < 1:
        raise ValueError("step_months must be at least 1")
    steps = F.greatest(F.lit(0), F.ceil(F.months_between(end, start) / F.lit(step_months)).cast("int") + 1)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.array(end),
        lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), -step_months))),
    )
    return F.array_sort(F.filter(walked, lambda d: d >= start))


def quote_instant(c: Column | str) -> Column:
    """Epoch seconds or timestamp text to an instant; text without a zone is UTC."""
    text = col(c).cast("string")
    epoch = text.try_cast("double")
    usable = ~F.isnan(epoch) & (F.abs(epoch) < F.lit(float("inf")))
    return F.coalesce(
        F.when(usable, F.timestamp_seconds(F.when(usable, epoch))),
        F.when(epoch.isNull(), text.try_cast("timestamp")),
    )


def session_close(session: Column | str) -> Column:
    """The instant at which the bar of ``session`` becomes final."""
    local = F.make_timestamp_ntz(F.year(col(session)), F.month(col(session)), F.day(col(session)),
                                 F.lit(CLOSE_HOUR), F.lit(0), F.lit(0))
    return F.to_utc_timestamp(local.cast("timestamp"), EXCHANGE_ZONE)


def session_open(instant: Column | str, now: Column) -> Column:
    """True while the New York session that ``instant`` belongs to has not closed."""
    local_day = F.to_date(F.from_utc_timestamp(col(instant), EXCHANGE_ZONE))
    return now < session_close(local_day)
