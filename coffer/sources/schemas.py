"""Declared table schemas. Nothing is inferred; every table carries its ledger key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "dim_date": (
        "date date, year int, month int, day int, day_of_week int, day_name string, "
        "month_name string, is_weekend boolean, quarter int, fiscal_year int, fiscal_month int, "
        "fiscal_month_label string, first_of_calendar_month date, first_of_fiscal_month date"
    ),
    "types": "id string, name string, sort_order int, created_at timestamp",
    "categories": (
        "id string, name string, type_id string, icon string, created_at timestamp"
    ),
    "savings_goals": (
        "account_id string, id string, name string, target_amount decimal(12,2), "
        "current_amount decimal(12,2), target_date date, status string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "transactions": (
        "account_id string, id string, transaction_date date, category_id string, "
        "savings_goal_id string, amount decimal(12,2), description string, "
        "payment_method string, is_recurring boolean, source string, raw_description string, "
        "import_batch_id string, created_at timestamp, updated_at timestamp"
    ),
    "budgets": (
        "account_id string, id string, type_id string, category_id string, start_date date, "
        "end_date date, budget_amount decimal(12,2), created_at timestamp"
    ),
    "merchant_rules": (
        "id string, keyword string, category_id string, priority int, created_at timestamp"
    ),
    "pay_dates": "account_id string, pay_date date, source string, note string",
    "expense_groups": "id string, name string, type string, sort_order int",
    "monthly_budgets": (
        "account_id string, category_id string, year_month date, budget_amount decimal(12,2)"
    ),
    "monthly_group_budgets": (
        "account_id string, expense_group_id string, year_month date, budget_amount decimal(12,2)"
    ),
    "statement": "Date string, Amount string, Description string, Balance string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add the nullable columns of a declared table that the input lacks, as typed NULLs."""
    missing = [f for f in schema(table).fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
