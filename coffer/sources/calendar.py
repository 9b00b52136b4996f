"""The date dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions.dates import calendar_columns
from coffer.functions.fixed_values import CALENDAR_END, CALENDAR_START, FISCAL_SHIFT_DAYS


def day_spine(df: DataFrame, start, end, day: str = "date") -> DataFrame:
    """One row per day between two date columns or values of each row, both ends included."""
    start, end = (F.lit(x) if isinstance(x, date) else F.col(x) for x in (start, end))
    return df.select(
        "*", F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias(day)
    )


def date_dim(
    spark: SparkSession,
    start: date = CALENDAR_START,
    end: date = CALENDAR_END,
    fiscal_shift_days: int = FISCAL_SHIFT_DAYS,
    pad_names: bool = False,
) -> DataFrame:
    """One row per day with calendar and fiscal attributes; its size is the length of the range."""
    days = day_spine(spark.range(1).select(), start, end)
    return with_calendar(days, "date", fiscal_shift_days, pad_names)


def with_calendar(
    df: DataFrame,
    column: str,
    fiscal_shift_days: int = FISCAL_SHIFT_DAYS,
    pad_names: bool = False,
) -> DataFrame:
    """Date-dimension attributes for any date column, computed in place without a join."""
    attributes = calendar_columns(column, fiscal_shift_days, pad_names)
    return df.select("*", *[c.alias(name) for name, c in attributes.items()])
