"""Steps between dates.  A semantic month keeps the day of the month and ends
of months; the other kind is a number of days."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def today() -> Column:
    return F.current_date()


def _leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def previous_day(d: Column) -> Column:
    return F.date_sub(d, 1)


def following_day(d: Column) -> Column:
    return F.date_add(d, 1)


def last_week(d: Column) -> Column:
    return F.date_sub(d, 7)


def next_week(d: Column) -> Column:
    return F.date_add(d, 7)


def last_month(d: Column, semantic: bool = True) -> Column:
    back = F.add_months(d, -1)
    return back if semantic else F.date_sub(d, F.day(F.last_day(back)))


def next_month(d: Column, semantic: bool = True) -> Column:
    if not semantic:
        return F.date_add(d, F.day(F.last_day(d)))
    on = F.add_months(d, 1)
    return F.when(d == F.last_day(d), F.last_day(on)).otherwise(on)


def last_year(d: Column) -> Column:
    return F.date_sub(d, F.when(_leap(F.year(d) - 1), 366).otherwise(365))


def next_year(d: Column) -> Column:
    return F.date_add(d, F.when(_leap(F.year(d)), 366).otherwise(365))


STEPS = {"daily": (previous_day, following_day), "weekly": (last_week, next_week), "monthly": (last_month, next_month), "yearly": (last_year, next_year)}


def last_date(d: Column, interval: str) -> Column:
    return _step(interval)[0](d)


def next_date(d: Column, interval: str) -> Column:
    return _step(interval)[1](d)


def _step(interval: str):
    if interval not in STEPS:
        raise ValueError(f"Unknown interval: {interval}")
    return STEPS[interval]


def _end(y: int, m: int) -> int:
    return calendar.monthrange(y, m)[1]


def _move(d: dt.date, step: str | dt.timedelta, back: bool) -> dt.date:
    if isinstance(step, dt.timedelta):
        return d + step
    if step in ("daily", "weekly"):
        return d + dt.timedelta(days=(7 if step == "weekly" else 1) * (-1 if back else 1))
    if step == "yearly":
        return d - dt.timedelta(days=366 if calendar.isleap(d.year - 1) else 365) if back else d + dt.timedelta(days=366 if calendar.isleap(d.year) else 365)
    k = d.year * 12 + d.month - 1 + (-1 if back else 1)
    y, m = k // 12, k % 12 + 1
    day = _end(y, m) if not back and d.day == _end(d.year, d.month) else min(d.day, _end(y, m))
    return dt.date(y, m, day)


def date_range(start: dt.date, stop: dt.date, step: str | dt.timedelta = "daily") -> Iterator[dt.date]:
    """Dates from start up to, but without, stop; each from the one before."""
    back = stop < start
    if isinstance(step, dt.timedelta):
        if not step or (step.days < 0) != back and start != stop:
            raise ValueError("The step leads away from the end")
    else:
        _step(step)
    while (start > stop) if back else (start < stop):
        yield start
        start = _move(start, step, back)


def dates_between(start: Column, stop: Column, days: int = 1) -> Column:
    """Array of every ``days``-th date, without stop, forwards."""
    return F.when(start < stop, F.sequence(start, F.date_sub(stop, 1), F.make_interval(days=F.lit(days)))).otherwise(F.array().cast("array<date>"))


def dates_by_step(start: Column, stop: Column, step: str) -> Column:
    """Months and years depend on the date before, so Python makes them."""
    _step(step)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else list(date_range(x, y, step)) for x, y in zip(a, b)])

    return F.pandas_udf(run, "array<date>")(start, stop)
