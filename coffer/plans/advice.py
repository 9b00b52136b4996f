"""Does a purchase fit the budget? For any number of requests at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions import fixed_values as fv
from coffer.functions.dates import month_start, next_month
from coffer.functions.money import money, ratio_pct
from coffer.keys import KEYS, key_list, shared, spread_join
from coffer.operators.budgets import as_of_budgets
from coffer.operators.dims import stg_categories
from coffer.operators.spend import with_month_spend
from coffer.operators.validation import purchase_rules, validate


class Assessment(NamedTuple):
    result: DataFrame
    rejects: DataFrame


def _decided(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    price, spent, budget = F.col("purchase_price"), F.col("spent_so_far"), F.col("budget_amount")
    projected = money(price + spent)
    left_before, left_after = money(budget - spent), money(budget - projected)
    used = ratio_pct(projected, budget).cast("decimal(20,1)")
    known = budget.isNotNull()
    decision = (
        F.when(~known, "no_budget")
        .when(projected > budget, "over_budget")
        .when(projected >= budget * F.col("warning_threshold"), "tight")
        .otherwise("within_budget")
    )
    text = lambda c: c.cast("string")
    reasons: dict[str, Column] = {
        "no_budget": F.format_string(fv.NO_BUDGET_REASON, "category", "expense_type"),
        "over_budget": F.format_string(
            fv.OVER_BUDGET_REASON, F.col("budget_scope"), text(F.abs(left_after))
        ),
        "tight": F.format_string(fv.TIGHT_REASON, text(used), F.col("budget_scope")),
        "within_budget": F.format_string(
            fv.WITHIN_BUDGET_REASON, F.col("budget_scope"), text(left_after)
        ),
    }
    df = df.withColumn("decision", decision)
    return df.select(
        "request_id",
        *keys,
        "item",
        "category",
        "expense_type",
        F.lit(fv.CURRENCY).alias("currency"),
        "period_start",
        "period_end_exclusive",
        "budget_scope",
        "purchase_price",
        "spent_so_far",
        "decision",
        F.when(known, ~(F.col("decision") == "over_budget")).alias("can_buy_within_budget"),
        "budget_amount",
        left_before.alias("remaining_before_purchase"),
        projected.alias("projected_spend"),
        left_after.alias("remaining_after_purchase"),
        used.cast("double").alias("projected_utilisation_pct"),
        F.coalesce(
            *[F.when(F.col("decision") == name, reason) for name, reason in reasons.items()]
        ).alias("reason"),
    )


def assess_purchases(
    requests: DataFrame,
    txns: DataFrame,
    budgets: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    keys: Sequence[str] = KEYS,
) -> Assessment:
    """Assess purchase requests against the budget in force and the month's spend.

    Requests: request_id, keys, item_name, price, category_name, purchase_date and optionally
    warning_threshold. Category names match in any case. Without a category budget the
    envelope of the type applies, and spend then counts the whole type, also where there is no
    budget at all. Invalid requests and unknown categories come back as rejects.

    Budget and spend are found once per distinct (ledger, category, day); the requests meet
    that result in one equi-join.
    """
    keys = key_list(keys)
    given = F.col("warning_threshold") if "warning_threshold" in requests.columns else F.lit(None)
    named = F.col("category_name") if "category_name" in requests.columns else F.lit(None)
    filled = requests.withColumn(
        "warning_threshold",
        F.coalesce(given.cast("decimal(4,3)"), F.lit(fv.WARNING_THRESHOLD)),
    ).withColumn("category_name", F.coalesce(named, F.lit(fv.DEFAULT_PURCHASE_CATEGORY)))
    valid, invalid = validate(filled, purchase_rules(filled))

    dims = stg_categories(categories, types, keys)
    own = shared(keys, dims)
    by_name = dims.groupBy(*own, F.lower("category_name").alias("_name")).agg(
        F.min(F.struct("category_name", "category_id", "type_id", "type_name")).alias("_found")
    )
    looked_up = spread_join(
        valid.withColumn("_name", F.lower("category_name")), by_name, [*own, "_name"], "left"
    )
    unknown = (
        looked_up.where(F.col("_found").isNull())
        .select(*filled.columns)
        .withColumn("reasons", F.array(F.lit("unknown category")))
    )
    asked = looked_up.where(F.col("_found").isNotNull()).select(
        "request_id",
        *keys,
        F.col("item_name").alias("item"),
        F.col("_found.category_name").alias("category"),
        F.col("_found.category_id").alias("category_id"),
        F.col("_found.type_id").alias("type_id"),
        F.col("_found.type_name").alias("expense_type"),
        "purchase_date",
        money("price").alias("purchase_price"),
        "warning_threshold",
    )

    wanted = (
        asked.select(*keys, "category_id", "type_id", "purchase_date")
        .distinct()
        .withColumn("month", month_start("purchase_date"))
    )
    spent = with_month_spend(as_of_budgets(wanted, budgets, keys), txns, categories, keys)
    cases = spent.select(
        *keys,
        "category_id",
        "type_id",
        "purchase_date",
        "scope",
        money("budget_amount").alias("budget_amount"),
        F.when(F.col("scope") == "category", F.col("category_spend"))
        .otherwise(F.col("type_spend"))
        .alias("spent_so_far"),
    )
    scope = (
        F.when(F.col("scope") == "category", "category")
        .when(F.col("scope") == "envelope", F.concat("expense_type", F.lit("_envelope")))
        .otherwise("unbudgeted_category")
    )
    joined = (
        asked.join(cases, [*keys, "category_id", "type_id", "purchase_date"])
        .withColumn("budget_scope", scope)
        .withColumn("period_start", month_start("purchase_date"))
        .withColumn("period_end_exclusive", next_month("purchase_date"))
    )
    return Assessment(_decided(joined, keys), invalid.unionByName(unknown))
