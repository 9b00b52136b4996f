"""Calendar-month views of the ledger."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import fixed_values as fv
from coffer.functions.dates import in_month, month_start
from coffer.functions.money import mean, money, pct, total
from coffer.keys import KEYS, key_list, shared
from coffer.operators.budgets import active, category_budgets
from coffer.operators.dims import stg_categories
from coffer.operators.spend import daily_totals, monthly_category_spend


def v_monthly_summary(
    txns: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    month: str | date | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Count, total and average per month, type and category.

    Transactions are summed per category id before names are joined. ``month`` filters the
    ledger's date column itself, so other months are not read.
    """
    keys = key_list(keys)
    if month is not None:
        txns = in_month(txns, "transaction_date", month)
    dims = stg_categories(categories, types, keys)
    named = monthly_category_spend(txns, keys).join(
        dims.select(*shared(keys, dims), "category_id", "category_name", "type_name"),
        [*shared(keys, dims), "category_id"],
    )
    return (
        named.groupBy(*keys, "month", "type_name", "category_name")
        .agg(
            F.sum("transaction_count").alias("transaction_count"),
            total("amount").alias("total_amount"),
        )
        .withColumn("avg_amount", mean("total_amount", "transaction_count"))
    )


def v_budget_vs_actual(
    budgets: DataFrame,
    categories: DataFrame,
    txns: DataFrame,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> DataFrame:
    """Active category budgets against the spend of each month within their validity.

    A budget without spend has one row, with no month. The range test runs on daily sums.
    """
    keys = key_list(keys)
    names = categories.select(
        *shared(keys, categories),
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
    )
    planned = (
        category_budgets(active(budgets, end))
        .select(*keys, "category_id", "start_date", "end_date", "budget_amount")
        .join(names, [*shared(keys, categories), "category_id"])
    )
    days = daily_totals(txns, keys).select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("category_id").alias("_category"),
        "transaction_date",
        "amount",
    )
    same = F.col("category_id") == F.col("_category")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    valid = (F.col("transaction_date") >= F.col("start_date")) & (
        F.col("transaction_date") < F.col("end_date")
    )
    sums = (
        planned.join(days, same & valid, "left")
        .groupBy(
            *keys,
            month_start("transaction_date").alias("month"),
            "category_name",
            money("budget_amount").alias("budget_amount"),
        )
        .agg(F.coalesce(total("amount"), F.lit(0).cast("decimal(18,2)")).alias("actual_amount"))
    )
    return sums.select(
        *keys,
        "month",
        "category_name",
        "budget_amount",
        "actual_amount",
        money(F.col("budget_amount") - F.col("actual_amount")).alias("remaining"),
        pct("actual_amount", "budget_amount").alias("utilisation_pct"),
    )
