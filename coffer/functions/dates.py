"""Date expressions: calendar and fiscal attributes, month bounds, validity, local days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions.fixed_values import FISCAL_SHIFT_DAYS, LOCAL_TIMEZONE


def as_col(value) -> Column:
    """A column name, a Column or a Python value as a Column (dates become literals)."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def month_start(d) -> Column:
    return F.trunc(as_col(d), "MM")


def next_month(d) -> Column:
    return F.add_months(month_start(d), 1)


def month_end(d) -> Column:
    return F.last_day(as_col(d))


def month_label(d) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")


def month_bounds(month: str | date) -> tuple[date, date]:
    """First day of the month and first day of the next one, for literal range filters."""
    if isinstance(month, str):
        year, number = month.split("-")
        month = date(int(year), int(number), 1)
    first = month.replace(day=1)
    return first, (first + timedelta(days=31)).replace(day=1)


def in_month(df: DataFrame, column: str, month: str | date) -> DataFrame:
    """Rows of one calendar month.

    The bounds are literals on the bare column, so parquet row groups and date partitions are
    pruned; wrapping the column in ``trunc`` would hide it from the scan.
    """
    first, following = month_bounds(month)
    return df.where((F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(following)))


def valid_at(df: DataFrame, day, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Versions in force on a day: start inclusive, end exclusive."""
    day = as_col(day)
    return df.where((F.col(start) <= day) & (F.col(end) > day))


def reference_day(month, as_of) -> Column:
    """``as_of`` moved into the month: past months give their last day, future ones their first."""
    first = month_start(month)
    return F.greatest(first, F.least(as_col(as_of), F.last_day(first)))


def local_date(ts, tz: str = LOCAL_TIMEZONE, source_tz: str | None = "UTC") -> Column:
    """Calendar day of a timestamp in a named zone.

    A timestamp without zone is taken to be in ``source_tz``, whatever the session's zone. For
    instants (Spark's plain timestamp type) pass ``source_tz=None``.
    """
    source = None if source_tz is None else F.lit(source_tz)
    return F.to_date(F.convert_timezone(source, F.lit(tz), as_col(ts)))


def calendar_columns(
    d, fiscal_shift_days: int = FISCAL_SHIFT_DAYS, pad_names: bool = False
) -> dict[str, Column]:
    """The attributes of the date dimension as expressions over any date column.

    ``pad_names`` pads day and month names with blanks to nine characters.
    """
    d = as_col(d)
    fiscal = F.date_sub(d, fiscal_shift_days)
    names = {"day_name": F.date_format(d, "EEEE"), "month_name": F.date_format(d, "MMMM")}
    if pad_names:
        names = {name: F.rpad(text, 9, " ") for name, text in names.items()}
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.day(d),
        "day_of_week": F.dayofweek(d) - 1,
        "day_name": names["day_name"],
        "month_name": names["month_name"],
        "is_weekend": F.dayofweek(d).isin(1, 7),
        "quarter": F.quarter(d),
        "fiscal_year": F.year(fiscal),
        "fiscal_month": F.month(fiscal),
        "fiscal_month_label": month_label(fiscal),
        "first_of_calendar_month": month_start(d),
        "first_of_fiscal_month": F.date_add(month_start(fiscal), fiscal_shift_days),
    }
