"""Calendar and elapsed-time expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reporting periods and their look-back (reference dashboard).
PERIOD_DAYS = {"week": 7, "month": 30, "year": 365}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_lit(value) -> Column:
    """A timestamp literal without zone (the driver tables are TIMESTAMP_NTZ)."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    return F.lit(value).cast("timestamp_ntz")


def floor_days(later, earlier) -> Column:
    """Whole days elapsed, floored (pandas ``(a - b).days``), not midnights."""
    micros = F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def period_start(period: str, as_of) -> Column:
    """Start of a reporting period ending at ``as_of``: today = midnight."""
    now = ts_lit(as_of) if not isinstance(as_of, Column) else as_of
    if period == "today":
        return F.date_trunc("day", now).cast("timestamp_ntz")
    days = PERIOD_DAYS[period]
    return now - F.expr(f"INTERVAL {days} DAYS")


def day_of_week(col) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(_c(col))


def is_weekend(col) -> Column:
    return day_of_week(col) >= 5


def calendar_columns(col) -> dict[str, Column]:
    """The calendar features of the reference feature builder."""
    c = _c(col)
    d = F.to_date(c)
    return {
        "day_of_week": day_of_week(c),
        "day_of_month": F.dayofmonth(c),
        "week_of_year": F.weekofyear(c),
        "month": F.month(c),
        "quarter": F.quarter(c),
        "year": F.year(c),
        "is_weekend": is_weekend(c).cast("int"),
        "is_month_start": (F.dayofmonth(c) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    }


def part_of_day(hour_col) -> Column:
    """<=11 morning, <=14 lunch, <=17 afternoon, <=21 dinner, else late."""
    h = _c(hour_col)
    return (F.when(h <= 11, "morning").when(h <= 14, "lunch")
            .when(h <= 17, "afternoon").when(h <= 21, "dinner").otherwise("late"))


def day_name(col) -> Column:
    return F.date_format(_c(col), "EEEE")
