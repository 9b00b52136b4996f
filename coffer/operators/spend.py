"""Spend at the grains the budget queries share. All are map-side combined aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coffer.functions.dates import month_start
from coffer.functions.money import MONEY, total
from coffer.keys import KEYS, key_list, shared


def daily_totals(txns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count and sum per ledger, day and category.

    The key spreads a large ledger over its days, and what it yields per ledger is bounded by
    days times categories: everything later (periods, windows, budgets) works on that.
    """
    return txns.groupBy(*key_list(keys), "transaction_date", "category_id").agg(
        F.count("*").alias("transaction_count"), total("amount").alias("amount")
    )


def monthly_category_spend(txns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count and sum per ledger, calendar month and category."""
    return txns.groupBy(
        *key_list(keys), month_start("transaction_date").alias("month"), "category_id"
    ).agg(F.count("*").alias("transaction_count"), total("amount").alias("amount"))


def with_month_spend(
    rows: DataFrame,
    txns: DataFrame,
    categories: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``category_spend`` and ``type_spend`` of the row's ledger and ``month``.

    Rows have keys, month, type_id and category_id (NULL where only the type matters). They
    are merged with the monthly sums and take theirs by window, so the transactions are read
    once for both grains and nothing is joined. A window holds one ledger's month of one type.
    """
    keys = key_list(keys)
    types = categories.select(
        *shared(keys, categories), F.col("id").alias("category_id"), "type_id"
    )
    spend = (
        monthly_category_spend(txns, keys)
        .join(types, [*shared(keys, categories), "category_id"])
        .select(*keys, "month", "category_id", "type_id", "amount", F.lit(0).alias("_is_row"))
        .withColumnRenamed("amount", "_amount")
    )
    merged = rows.withColumn("_is_row", F.lit(1)).unionByName(spend, allowMissingColumns=True)
    within = lambda *columns: F.coalesce(
        F.sum("_amount").over(Window.partitionBy(*keys, *columns)), F.lit(0)
    ).cast(MONEY)
    return (
        merged.repartition(*keys, "month")
        .withColumn("category_spend", within("month", "category_id"))
        .withColumn("type_spend", within("month", "type_id"))
        .where(F.col("_is_row") == 1)
        .drop("_is_row", "_amount")
    )
