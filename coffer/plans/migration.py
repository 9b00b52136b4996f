"""Moving legacy budgets, one table per scope, into versioned budgets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import fixed_values as fv
from coffer.keys import KEYS, key_list, shared
from coffer.operators.quality import check_copied, check_row_parity


class Unified(NamedTuple):
    budgets: DataFrame
    checks: DataFrame


def unify_budgets(
    monthly: DataFrame,
    group_monthly: DataFrame,
    categories: DataFrame,
    groups: DataFrame,
    types: DataFrame,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> Unified:
    """Monthly category budgets and monthly group budgets as one table of open versions.

    A category budget takes its type from the category; a group budget becomes the envelope of
    the type of the same name (of several the one of least id), within the ledger if groups or
    types carry its keys. The checks report rows lost or changed on the way.
    """
    keys = key_list(keys)
    category_types = categories.select(
        *shared(keys, categories), F.col("id").alias("category_id"), "type_id"
    )
    columns = [*keys, "type_id", "category_id", "start_date", "end_date", "budget_amount"]
    by_category = (
        monthly.join(category_types, [*shared(keys, categories), "category_id"])
        .withColumn("start_date", F.col("year_month"))
        .withColumn("end_date", F.lit(end))
        .select(*columns)
    )
    own_groups, own_types = shared(keys, groups), shared(keys, types)
    type_names = types.groupBy(*own_types, "name").agg(F.min("id").alias("type_id"))
    group_types = (
        groups.select(*own_groups, F.col("id").alias("expense_group_id"), "name")
        .join(type_names, [*(k for k in own_types if k in own_groups), "name"])
        .drop("name")
    )
    of_group = [*shared(keys, group_types), "expense_group_id"]
    grouped = (
        group_monthly.join(group_types, of_group)
        .withColumn("category_id", F.lit(None).cast(monthly.schema["category_id"].dataType))
        .withColumn("start_date", F.col("year_month"))
        .withColumn("end_date", F.lit(end))
    )
    budgets = by_category.unionByName(grouped.select(*columns))

    single, shared_rows = F.col("category_id").isNotNull(), F.col("category_id").isNull()
    expected_groups = group_monthly.join(group_types, of_group, "left").withColumn(
        "start_date", F.col("year_month")
    )
    checks = (
        check_row_parity("category budget rows", monthly, budgets.where(single))
        .unionByName(
            check_row_parity("envelope budget rows", group_monthly, budgets.where(shared_rows))
        )
        .unionByName(
            check_copied(
                "category budget values",
                monthly.withColumn("start_date", F.col("year_month")),
                budgets.where(single),
                [*keys, "category_id", "start_date", "budget_amount"],
            )
        )
        .unionByName(
            check_copied(
                "envelope budget values",
                expected_groups,
                budgets.where(shared_rows),
                [*keys, "type_id", "start_date", "budget_amount"],
            )
        )
    )
    return Unified(budgets, checks)
