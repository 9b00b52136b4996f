from coffer.plans.advice import assess_purchases
from coffer.plans.marts import (
    build_marts,
    fct_budget_vs_actual,
    fct_expense_group_summary,
    fct_monthly_summary,
    fct_pay_period_summary,
    fct_savings_rate,
    write_marts,
)
from coffer.plans.migration import unify_budgets
from coffer.plans.quality_rules import ledger_rules, migration_preflight
from coffer.plans.reports import (
    budget_status,
    categories_by_type,
    get_transactions,
    goal_linked,
    goal_progress,
    imported_rows,
    list_categories,
    list_goals,
    list_pay_dates,
    list_rules,
    list_transactions,
    list_types,
    monthly_spending,
    monthly_totals,
    page_ends,
    plan_summary,
    reconcile,
    search_transactions,
    sheet_balance,
    to_json,
    to_nested,
)
from coffer.plans.staging import stage_daily, stg_transactions
from coffer.plans.statement_import import import_statement, outputs
from coffer.plans.views import v_budget_vs_actual, v_monthly_summary

__all__ = [name for name in dir() if not name.startswith("_")]
