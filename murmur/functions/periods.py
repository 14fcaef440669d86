"""Period columns and date predicates (P5-P7, E8, G5 grains)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.params import check_grain


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x) -> Column:
    if isinstance(x, (dt.date, dt.datetime)):
        return F.lit(x.isoformat()[:10]).cast("date")
    if isinstance(x, str) and len(x) in (7, 10) and x[4] == "-":
        return F.lit(x if len(x) == 10 else x + "-01").cast("date")
    return _c(x).cast("date")


def rollup_period(date, grain: str) -> Column:
    """date_trunc to day/week(Monday)/month; unknown grain → day."""
    unit = grain if grain in ("week", "month") else "day"
    return F.date_trunc(unit, _c(date)).cast("date")


def chart_period_label(ts, grain: str) -> Column:
    """E8 labels: month 'yyyy-MM', day 'yyyy-MM-dd', week = Monday + 1 day - 1 week."""
    check_grain(grain)
    ts = _c(ts)
    if grain == "month":
        return F.date_format(F.date_trunc("month", ts), "yyyy-MM")
    if grain == "day":
        return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")
    monday = F.date_trunc("week", ts).cast("date")
    return F.date_format(F.date_sub(monday, 6), "yyyy-MM-dd")


def month_range(ts, start_month, end_month) -> Column:
    """P5: first day of start month <= ts < first day after end month.

    A start after the end is clamped to the end, as the reference does.
    """
    start = F.trunc(_d(start_month), "month")
    end = F.trunc(_d(end_month), "month")
    start = F.least(start, end)
    ts = _c(ts)
    return (ts >= start.cast("timestamp_ntz")) & (ts < F.add_months(end, 1).cast("timestamp_ntz"))


def on_day(ts, day) -> Column:
    """One calendar day as a half-open range, so it prunes and pushes down."""
    d = _d(day)
    ts = _c(ts)
    return (ts >= d.cast("timestamp_ntz")) & (ts < F.date_add(d, 1).cast("timestamp_ntz"))


def date_between(date, start, end) -> Column:
    """Inclusive date range on rollup dates."""
    return _c(date).between(_d(start), _d(end))


def iso_day(date) -> Column:
    return F.date_format(_c(date), "yyyy-MM-dd")
