from coffer.operators.budgets import (
    active,
    as_of_budgets,
    budget_segments,
    category_budgets,
    envelopes,
    list_budgets,
    overwrite_active,
    resolve_budget,
    scd2_apply,
)
from coffer.operators.categorise import categorise, keyword_index, match_rules, rule_candidates
from coffer.operators.dedup import dedup_new, first_rows, known_keys
from coffer.operators.dims import enrich_transactions, stg_categories
from coffer.operators.periods import (
    as_of_periods,
    assign_periods,
    detect_pay_dates,
    near_dates,
    not_near,
    pay_periods,
)
from coffer.operators.quality import (
    TableRules,
    check_accepted,
    check_copied,
    check_count,
    check_distinct_count,
    check_not_null,
    check_relationship,
    check_row_parity,
    check_unique,
    check_value_set,
    quality_report,
    table_counts,
)
from coffer.operators.spend import daily_totals, monthly_category_spend, with_month_spend
from coffer.operators.tables import (
    append_transactions,
    backfill_key,
    delete_keys,
    insert_missing,
    patch,
    tag_by_name,
    upsert,
)
from coffer.operators.validation import validate

__all__ = [name for name in dir() if not name.startswith("_")]
