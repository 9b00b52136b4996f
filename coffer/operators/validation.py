"""Row rules: CHECK constraints and request bounds, with the reasons of each rejection."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions import fixed_values as fv

Rules = Mapping[str, Column]


class Validated(NamedTuple):
    ok: DataFrame
    rejects: DataFrame


def required(*columns: str) -> dict[str, Column]:
    return {f"{c} is required": F.col(c).isNotNull() for c in columns}


def _present(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> dict[str, Column]:
    return {name: rule for name, (column, rule) in rules.items() if column in df.columns}


def transaction_rules(df: DataFrame) -> dict[str, Column]:
    return {
        **required("transaction_date", "category_id", "amount"),
        **_present(
            df,
            {
                "amount must be positive": ("amount", F.col("amount") > 0),
                "unknown payment_method": (
                    "payment_method",
                    F.col("payment_method").isin(*fv.PAYMENT_METHODS),
                ),
                "unknown source": ("source", F.col("source").isin(*fv.TRANSACTION_SOURCES)),
                "description too long": ("description", F.length("description") <= 255),
                "raw_description too long": (
                    "raw_description",
                    F.length("raw_description") <= 255,
                ),
            },
        ),
    }


def budget_rules(df: DataFrame, end: date = fv.ACTIVE_END) -> dict[str, Column]:
    """Rules of budget rows, or of changes, which have no end date of their own yet."""
    last = F.col("end_date") if "end_date" in df.columns else F.lit(end)
    return {
        **required("type_id", "start_date", "budget_amount"),
        "budget_amount must not be negative": F.col("budget_amount") >= 0,
        "end_date must follow start_date": last > F.col("start_date"),
    }


def goal_rules(df: DataFrame) -> dict[str, Column]:
    return {
        **required("name", "target_amount"),
        "target_amount must be positive": F.col("target_amount") > 0,
        **_present(
            df,
            {
                "current_amount must not be negative": (
                    "current_amount",
                    F.col("current_amount") >= 0,
                ),
                "unknown status": ("status", F.col("status").isin(*fv.GOAL_STATUSES)),
            },
        ),
    }


def type_rules(df: DataFrame) -> dict[str, Column]:
    return {
        **required("name", "sort_order"),
        "unknown type": F.col("name").isin(*fv.TYPE_NAMES),
        "sort_order out of range": F.col("sort_order").between(1, 4),
    }


def pay_date_rules(df: DataFrame) -> dict[str, Column]:
    return {
        **required("pay_date", "source"),
        "unknown source": F.col("source").isin(*fv.PAY_DATE_SOURCES),
    }


def purchase_rules(df: DataFrame) -> dict[str, Column]:
    return {
        **required("item_name", "price", "category_name", "purchase_date"),
        "price must be positive": F.col("price") > 0,
        "item_name must have 1 to 100 characters": F.length("item_name").between(1, 100),
        "category_name must have 1 to 50 characters": F.length("category_name").between(1, 50),
        "warning_threshold out of range": F.col("warning_threshold").between(
            F.lit(fv.WARNING_THRESHOLD_MIN), F.lit(fv.WARNING_THRESHOLD_MAX)
        ),
    }


def failed_rules(rules: Rules) -> Column:
    """Names of the rules a row breaks. As in a CHECK constraint, unknown is not broken."""
    return names_of({name: ~rule for name, rule in rules.items()}, ~keeps_rules(rules))


def names_of(failures: Mapping[str, Column], any_failed: Column) -> Column:
    """Names of the conditions that hold; the list is made only for rows with one."""
    found = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in failures.items()]))
    return F.when(any_failed, found).otherwise(F.array().cast("array<string>"))


def keeps_rules(rules: Rules) -> Column:
    """Whether a row breaks no rule; cheaper than collecting the names of those it breaks."""
    return reduce(Column.__and__, [F.coalesce(rule, F.lit(True)) for rule in rules.values()])


def validate(df: DataFrame, rules: Rules) -> Validated:
    """Split rows into valid ones and rejects with a ``reasons`` array."""
    kept = keeps_rules(rules)
    return Validated(
        df.where(kept), df.where(~kept).withColumn("reasons", failed_rules(rules))
    )
