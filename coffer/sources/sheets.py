"""Wide expense sheets: one column per kind of expense, one row per period."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.keys import KEYS, shared, spread_join


class SheetRows(NamedTuple):
    ok: DataFrame
    warnings: DataFrame


def _with_category(df: DataFrame, categories: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The category of each row by name, within the ledger if categories carry its keys; of
    several categories of one name the one of least id."""
    on = [*shared(keys, categories), "category"]
    names = categories.withColumn("category", F.col("name")).groupBy(*on)
    return df.join(names.agg(F.min("id").alias("category_id")), on, "left")


def unpivot_sheet(
    df: DataFrame,
    id_cols: Sequence[str],
    mapping: DataFrame,
    categories: DataFrame,
    period_start: str | None = None,
    keys: Sequence[str] = KEYS,
) -> SheetRows:
    """Turn sheet columns into transactions.

    ``mapping`` has a row per column: ``column``, ``category``, ``description`` and either an
    absolute ``date`` or, with ``period_start``, a ``day_offset`` from the start of the row's
    period. Empty and zero cells are skipped. Cells of a category that does not exist become
    warnings. Columns without a mapping are ignored. A mapping or categories that carry ledger
    ``keys`` hold for that ledger.
    """
    value_cols = [c for c in df.columns if c not in id_cols]
    cells = df.select(
        *id_cols, *[F.col(f"`{c}`").cast("decimal(12,2)").alias(c) for c in value_cols]
    ).unpivot(list(id_cols), value_cols, "column", "amount")
    cells = cells.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    on = [*shared(keys, mapping), "column"]
    if period_start:
        mapped = cells.join(mapping, on).withColumn(
            "transaction_date", F.date_add(F.col(period_start), F.col("day_offset"))
        )
    else:
        mapped = cells.join(mapping, on).withColumn("transaction_date", F.col("date"))
    found = _with_category(mapped, categories, keys)
    ok = found.where(F.col("category_id").isNotNull()).select(
        *id_cols,
        "column",
        "transaction_date",
        "category_id",
        "amount",
        "description",
        F.lit("card").alias("payment_method"),
    )
    warnings = found.where(F.col("category_id").isNull()).select(
        *id_cols,
        "column",
        "category",
        F.concat(
            F.lit("Category '"), "category", F.lit("' not found, skipping "), "column"
        ).alias("message"),
    )
    return SheetRows(ok, warnings)


def expand_breakdown(
    parts: DataFrame, totals: DataFrame, categories: DataFrame, keys: Sequence[str]
) -> SheetRows:
    """Breakdown lines of the accounts whose stated total is set and not zero.

    ``parts``: keys, category, amount, transaction_date, description. ``totals``: keys,
    stated_total.
    """
    stated = totals.where(F.col("stated_total").isNotNull() & (F.col("stated_total") != 0))
    found = _with_category(
        spread_join(parts, stated.select(*keys).distinct(), keys, "left_semi"), categories, keys
    )
    ok = found.where(F.col("category_id").isNotNull()).select(
        *keys,
        "transaction_date",
        "category_id",
        "amount",
        "description",
        F.lit("card").alias("payment_method"),
    )
    warnings = found.where(F.col("category_id").isNull()).select(
        *keys,
        "category",
        F.concat(F.lit("Category '"), "category", F.lit("' not found")).alias("message"),
    )
    return SheetRows(ok, warnings)
