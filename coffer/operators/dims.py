"""Joins of facts with the category and type dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions.money import category_type
from coffer.keys import KEYS, key_list, shared, spread_join


def stg_categories(
    categories: DataFrame, types: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Categories with their type and broad class. One row per category of a known type."""
    keys = key_list(keys)
    type_rows = types.select(
        *shared(keys, types),
        F.col("id").alias("type_id"),
        F.col("name").alias("type_name"),
        F.col("sort_order").alias("type_sort_order"),
    )
    on = [k for k in shared(keys, categories) if k in types.columns]
    extra = [c for c in ("icon", "created_at") if c in categories.columns]
    return categories.join(type_rows, [*on, "type_id"]).select(
        *shared(keys, categories),
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        "type_id",
        "type_name",
        "type_sort_order",
        category_type("type_name").alias("category_type"),
        *extra,
    )


def enrich_transactions(
    txns: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    how: str = "left",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Transactions with category and type names: ``left`` keeps rows without a category,
    ``inner`` drops them. A large fact is joined once, to the already joined dimensions."""
    keys = key_list(keys)
    dims = stg_categories(categories, types, keys).select(
        *shared(keys, categories), "category_id", "category_name", "type_id", "type_name"
    )
    return spread_join(txns, dims, [*shared(keys, categories), "category_id"], how)
