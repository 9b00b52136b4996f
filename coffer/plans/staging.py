"""Staging: cleaned transactions with calendar attributes and pay periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import fixed_values as fv
from coffer.functions.dates import month_label
from coffer.keys import KEYS, key_list
from coffer.operators.periods import as_of_periods, assign_periods
from coffer.operators.spend import daily_totals
from coffer.sources.schemas import conform


def _without_period(df: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("date")
    return df.select("*", nothing.alias("pay_period_start"), nothing.alias("pay_period_end"))


def stg_transactions(
    txns: DataFrame,
    dim_date: DataFrame,
    periods: DataFrame | None,
    keys: Sequence[str] = KEYS,
    method: str = "as_of",
) -> DataFrame:
    """Cleaned transactions, one row per transaction whose date is in the date dimension.

    Without ``periods`` the period columns are NULL and the plan has no shuffle of its own.
    ``method`` is that of :func:`assign_periods`.
    """
    keys = key_list(keys)
    calendar = dim_date.select(
        F.col("date").alias("transaction_date"),
        F.col("year").alias("calendar_year"),
        F.col("month").alias("calendar_month"),
        F.col("day").alias("calendar_day"),
        "day_of_week",
        "day_name",
        "month_name",
        "is_weekend",
        "quarter",
    )
    rows = conform(txns, "transactions").join(calendar, "transaction_date")
    if periods is None:
        rows = _without_period(rows)
    else:
        rows = assign_periods(rows, periods, keys, method=method)
    return rows.select(
        *keys,
        "id",
        "transaction_date",
        "category_id",
        "savings_goal_id",
        "amount",
        F.coalesce("description", F.lit(fv.NO_DESCRIPTION)).alias("description"),
        "payment_method",
        "is_recurring",
        "source",
        "raw_description",
        "import_batch_id",
        "calendar_year",
        "calendar_month",
        "calendar_day",
        "day_of_week",
        "day_name",
        "month_name",
        "is_weekend",
        "quarter",
        "pay_period_start",
        "pay_period_end",
        month_label("transaction_date").alias("year_month"),
        "created_at",
        "updated_at",
    )


def stage_daily(
    txns: DataFrame,
    dim_date: DataFrame,
    periods: DataFrame | None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The staged columns that the marts use, at day and category grain.

    Same totals as :func:`stg_transactions`, but the transactions are summed before the period
    lookup, which then needs one exchange of the small result and no join back.
    """
    keys = key_list(keys)
    days = daily_totals(txns, keys).join(
        dim_date.select(F.col("date").alias("transaction_date")), "transaction_date", "left_semi"
    )
    return _without_period(days) if periods is None else as_of_periods(days, periods, keys)
