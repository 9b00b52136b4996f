"""Seed relations: types, categories and merchant rules, linked by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coffer.functions import fixed_values as fv
from coffer.keys import KEYS, shared, spread_join


def values(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small constant table as literals of the plan.

    Unlike rows shipped from Python its size is known to the optimizer, which then broadcasts
    it instead of shuffling the table it is joined with.
    """
    fields = StructType.fromDDL(ddl).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def lookup_id(
    df: DataFrame,
    dim: DataFrame,
    name: str,
    out: str,
    dim_name: str = "name",
    dim_id: str = "id",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Replace a name column by the id of the row of that name; rows without one get NULL.

    A dimension that carries ledger keys is looked up within the ledger. Of several rows of one
    name the least id counts; ``check_unique`` reports them.
    """
    on = [*shared(keys, dim), name]
    named = dim.select(*shared(keys, dim), F.col(dim_name).alias(name), F.col(dim_id).alias(out))
    return spread_join(df, named.groupBy(*on).agg(F.min(out).alias(out)), on, "left").drop(name)


def seed_reference(
    spark: SparkSession,
    types: Sequence[tuple] = fv.TYPES,
    categories: Sequence[tuple] = fv.CATEGORIES,
    rules: Sequence[tuple] = fv.MERCHANT_RULES,
) -> dict[str, DataFrame]:
    """Types, categories and merchant rules as tables. Ids are the names, lower-cased."""
    type_rows = values(spark, types, "name string, sort_order int")
    category_rows = values(spark, categories, "name string, type string")
    rule_rows = values(spark, rules, "keyword string, category string, priority int")

    type_table = type_rows.select(F.lower("name").alias("id"), "name", "sort_order")
    category_table = lookup_id(category_rows, type_table, "type", "type_id").select(
        F.lower("name").alias("id"), "name", "type_id"
    )
    rule_table = lookup_id(rule_rows, category_table, "category", "category_id").select(
        F.lower("keyword").alias("id"), "keyword", "category_id", "priority"
    )
    return {"types": type_table, "categories": category_table, "merchant_rules": rule_table}
