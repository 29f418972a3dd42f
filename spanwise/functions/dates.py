"""Date expressions: partial dates, reporting periods, quarter codes, overlap lengths."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of an open end, and the bounds of the time line.
OPEN_END = "9999-01-01"
OPEN_END_LATE = "9999-12-31"
ORIGIN = "1900-01-01"
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"
OPEN_YEAR = 9999


def as_date(value: str | dt.date | Column) -> Column:
    """Literal or column as a DATE column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("date")


def literal_day(value: str | dt.date) -> dt.date:
    """A fixed day given as date or as year-month-day text, with or without leading zeros."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date(*[int(part) for part in str(value).strip().split("-")])
    except (TypeError, ValueError):
        raise ValueError(f"{value!r} is no day") from None


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """S11. Date from parts; NULL when a part is NULL or the parts name no day."""
    y = F.when(year.between(1, 9999), year.cast("int"))
    m = F.when(month.between(1, 12), month.cast("int"))
    d = F.when(day.between(1, 31), day.cast("int"))
    built = F.date_add(F.make_date(y, m, F.lit(1)), d - 1)
    return F.when(F.month(built) == m, built)


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def month_index(date: Column) -> Column:
    """Whole months since year 0: neighbouring calendar months differ by one."""
    return F.year(date) * 12 + F.month(date)


def reporting_period_start(returned: Column, given_start: Column, start_tol: int = 60) -> Column:
    near = (given_start < returned) & (F.datediff(returned, given_start) < start_tol)
    return F.when(given_start.isNotNull() & near, given_start).otherwise(F.trunc(returned, "MM"))


def reporting_period_end(returned: Column, given_start: Column, given_end: Column, end_tol: int = 27) -> Column:
    near = (given_end < returned) & (F.datediff(returned, given_end) < end_tol)
    ordered = given_start.isNull() | (given_start < given_end)
    return F.when(given_end.isNotNull() & near & ordered, given_end).otherwise(returned)


def add_years_unless_open(date: Column, years: int) -> Column:
    return F.when(F.year(date) == OPEN_YEAR, date).otherwise(F.add_months(date, 12 * years))


# Three-letter code of each quarter and the month it starts in.
QUARTER_MONTHS = {"JAN": 1, "APR": 4, "JUL": 7, "OCT": 10}


def parse_quarter_code(code: Column) -> Column:
    """L1. `JANyy` / `APRyy` / `JULyy` / `OCTyy` -> first day of that quarter in 20yy."""
    quarter = F.upper(F.left(code, F.lit(3)))
    month = F.lit(None).cast("int")
    for text, number in QUARTER_MONTHS.items():
        month = F.when(quarter == text, number).otherwise(month)
    year = 2000 + F.right(code, F.lit(2)).try_cast("int")
    return F.make_date(year, month, F.lit(1))


def quarter_bounds(year: int, quarter: int) -> tuple[dt.date, dt.date]:
    first = dt.date(year, 3 * quarter - 2, 1)
    after = dt.date(year + 1, 1, 1) if quarter == 4 else dt.date(year, 3 * quarter + 1, 1)
    return first, after - dt.timedelta(days=1)


def quarters_of(*years: int) -> dict[str, tuple[dt.date, dt.date]]:
    """`{'2017Q1': (first day, last day), ...}` in time order."""
    return {f"{y}Q{q}": quarter_bounds(y, q) for y in years for q in (1, 2, 3, 4)}
