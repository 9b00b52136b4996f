"""The rules the ledger's tables, staging and marts have to satisfy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions import fixed_values as fv
from coffer.keys import KEYS, key_list, shared
from coffer.operators.quality import (
    TableRules,
    check_relationship,
    check_unique,
    not_null_tests,
    one_pass,
    same_tests,
    union_all,
)
from coffer.operators.validation import (
    budget_rules,
    goal_rules,
    pay_date_rules,
    transaction_rules,
    type_rules,
)


def _checks(rules: Mapping) -> dict:
    """Without the rules that not_null tests repeat."""
    return {name: rule for name, rule in rules.items() if not name.endswith("is required")}


def ledger_rules(
    tables: Mapping[str, DataFrame], keys: Sequence[str] = KEYS
) -> dict[str, TableRules]:
    """Rules of the tables present in ``tables``, by table name."""
    keys = key_list(keys)
    own = {name: shared(keys, df) for name, df in tables.items()}
    key = lambda name, *columns: [*own[name], *columns]

    def link(name: str, columns: Sequence[str], parent: str, parent_columns: Sequence[str]):
        if parent not in tables:
            return {}
        both = [k for k in own[name] if k in own[parent]]
        return {(*both, *columns): (parent, (*both, *parent_columns))}

    period = ["period_label", "period_start_date", "period_end_date", "period_basis"]
    basis = {"period_basis": fv.PERIOD_BASES}
    is_active = F.col("end_date") == F.lit(fv.ACTIVE_END)

    def types():
        return TableRules(
            not_null=["id", "name", "sort_order"],
            unique=[key("types", "id"), key("types", "name"), key("types", "sort_order")],
            checks=_checks(type_rules(tables["types"])),
        )

    def categories():
        return TableRules(
            not_null=["id", "name", "type_id"],
            unique=[
                key("categories", "id"),
                key("categories", "name"),
                key("categories", "id", "type_id"),
            ],
            relationships=link("categories", ["type_id"], "types", ["id"]),
        )

    def transactions():
        df = tables["transactions"]
        return TableRules(
            not_null=["id", "transaction_date", "category_id", "amount", "source"],
            unique=[key("transactions", "id")],
            checks=_checks(transaction_rules(df)),
            relationships={
                **link("transactions", ["category_id"], "categories", ["id"]),
                **link("transactions", ["transaction_date"], "dim_date", ["date"]),
                **(
                    link("transactions", ["savings_goal_id"], "savings_goals", ["id"])
                    if "savings_goal_id" in df.columns
                    else {}
                ),
            },
            not_empty=True,
        )

    def budgets():
        single = F.col("category_id").isNotNull()
        return TableRules(
            not_null=["id", "type_id", "start_date", "end_date", "budget_amount"],
            unique=[key("budgets", "id")],
            unique_where={
                "one active budget per category": (
                    key("budgets", "type_id", "category_id"),
                    single & is_active,
                ),
                "one active envelope per type": (key("budgets", "type_id"), ~single & is_active),
            },
            checks=_checks(budget_rules(tables["budgets"])),
            relationships={
                **link("budgets", ["type_id"], "types", ["id"]),
                **link("budgets", ["category_id", "type_id"], "categories", ["id", "type_id"]),
            },
        )

    def savings_goals():
        return TableRules(
            not_null=["id", "name", "target_amount"],
            unique=[key("savings_goals", "id")],
            checks=_checks(goal_rules(tables["savings_goals"])),
        )

    def merchant_rules():
        return TableRules(
            not_null=["keyword", "category_id", "priority"],
            unique=[key("merchant_rules", "keyword")],
            relationships=link("merchant_rules", ["category_id"], "categories", ["id"]),
        )

    def pay_dates():
        return TableRules(
            not_null=["pay_date", "source"],
            unique=[key("pay_dates", "pay_date")],
            checks=_checks(pay_date_rules(tables["pay_dates"])),
            parity=[p for p in ("v_pay_periods",) if p in tables],
        )

    def v_pay_periods():
        return TableRules(
            not_null=["period_start", "period_end"],
            unique=[key("v_pay_periods", "period_start")],
        )

    def dim_date():
        return TableRules(not_null=list(tables["dim_date"].columns), unique=[["date"]])

    def stg_transactions():
        return TableRules(not_null=["id"], unique=[key("stg_transactions", "id")])

    def stg_categories():
        return TableRules(
            not_null=["category_id"], unique=[key("stg_categories", "category_id")]
        )

    def fct_pay_period_summary():
        return TableRules(not_null=[*period, "category_name", "total_amount"], accepted=basis)

    def fct_monthly_summary():
        return fct_pay_period_summary()

    def fct_savings_rate():
        return TableRules(
            not_null=["period_start_date", "period_label", "period_basis"],
            unique=[key("fct_savings_rate", "period_start_date")],
            accepted=basis,
        )

    def fct_budget_vs_actual():
        return TableRules(
            not_null=["fiscal_month"], accepted={"budget_status": fv.MART_STATUSES}
        )

    def fct_expense_group_summary():
        return TableRules(
            not_null=["fiscal_month", "expense_group"],
            accepted={"expense_group": fv.EXPENSE_TYPES},
        )

    known = [
        types, categories, transactions, budgets, savings_goals, merchant_rules, pay_dates,
        v_pay_periods, dim_date, stg_transactions, stg_categories, fct_pay_period_summary,
        fct_monthly_summary, fct_savings_rate, fct_budget_vs_actual, fct_expense_group_summary,
    ]
    return {rule.__name__: rule() for rule in known if rule.__name__ in tables}


def migration_preflight(
    categories: DataFrame,
    groups: DataFrame,
    monthly: DataFrame,
    group_monthly: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """What has to hold before :func:`unify_budgets`: rows of check, table, column, violations.

    Each ledger has exactly the known groups, once each, and the categories that the seeded
    merchant rules need (violations: ledgers that differ; an empty table counts as one); categories
    have a group and its type; a category or group has one monthly budget. A table without the
    ledgers' keys is one ledger.
    """
    keys = key_list(keys)

    def names(df: DataFrame, table: str, wanted: Sequence[str], only: bool) -> DataFrame:
        # the names of a ledger are bits, as counting distinct ones would keep a row for each in memory
        named = F.col("name").isin(*wanted)
        words = [wanted[i : i + 60] for i in range(0, len(wanted), 60)]
        bit = lambda word: reduce(
            lambda c, i: c.when(F.col("name") == word[i], 1 << i), range(1, len(word)), F.when(F.col("name") == word[0], 1)
        )
        by_ledger = df.groupBy(*shared(keys, df)).agg(
            F.count_if(named).alias("rows"),
            F.count_if(~F.coalesce(named, F.lit(False))).alias("others"),
            *[F.bit_or(bit(word).cast("bigint")).alias(f"_word{i}") for i, word in enumerate(words)],
        )
        n = F.lit(len(wanted))
        names = reduce(Column.__add__, [F.coalesce(F.bit_count(f"_word{i}"), F.lit(0)) for i in range(len(words))])
        bad = (F.col("rows") != n) | (names != n)
        if only:
            bad = bad | (F.col("others") > 0)
        missing = F.when(F.count("*") == 0, 1).otherwise(F.count_if(bad))
        return one_pass(by_ledger, table, {}, {("names", "name"): missing})

    needed = sorted({category for _, category, _ in fv.MERCHANT_RULES})
    both = [k for k in shared(keys, categories) if k in groups.columns]
    group_types = groups.groupBy(*both, F.col("id").alias("expense_group_id")).agg(
        F.min("type").alias("group_type")
    )
    # equal rows are counted first, so that a ledger's many categories meet its groups as a few rows
    typed = categories.groupBy(*both, "expense_group_id", "type").agg(F.count("*").alias("_rows")).join(
        group_types, [*both, "expense_group_id"]
    )
    differ = {
        name: F.coalesce(F.sum(F.when(bad, F.col("_rows"))), F.lit(0))
        for name, bad in same_tests([("type", "group_type")]).items()
    }
    of_group, group_id = (*both, "expense_group_id"), (*both, "id")
    return union_all(
        [
            names(groups, "expense_groups", fv.TYPE_NAMES, only=True),
            names(categories, "categories", needed, only=False),
            one_pass(categories, "categories", not_null_tests(["expense_group_id"])),
            check_relationship(categories, "categories", of_group, groups, group_id),
            one_pass(typed, "categories", {}, differ),
            check_unique(monthly, "monthly_budgets", [*shared(keys, monthly), "category_id"]),
            check_unique(
                group_monthly,
                "monthly_group_budgets",
                [*shared(keys, group_monthly), "expense_group_id"],
            ),
        ]
    )
