import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from coffer import plans
from coffer.operators import pay_periods, stg_categories
from coffer.session import work_dir
from coffer.sources import date_dim
from coffer.plans.marts import write_marts
from conftest import D, M, budgets, pay_dates, rows, txns


def summary(spark, dims, ledger, dates, mode="payday"):
    stg_c = stg_categories(dims["categories"], dims["types"])
    staged = plans.stage_daily(ledger, date_dim(spark), pay_periods(pay_dates(spark, dates)))
    return plans.fct_pay_period_summary(staged, stg_c, mode), stg_c


def test_days_before_the_first_payday_fall_back_to_the_month(spark, dims):
    pps, _ = summary(spark, dims, txns(spark, [("2026-03-05", "rent", 10), ("2026-03-20", "rent", 5)]), ["2026-03-13"])
    assert rows(pps, "period_label", "period_start_date", "period_end_date", "period_basis") == [
        ("2026-03", D("2026-03-01"), D("2026-03-31"), "calendar_fallback"),
        ("2026-03-13", D("2026-03-13"), D("2030-01-01"), "payday"),
    ]


def test_running_total_is_shared_by_ties_and_never_resets(spark, dims):
    ledger = txns(
        spark,
        [("2025-12-05", "rent", 10), ("2025-12-06", "groceries", 5), ("2026-01-07", "rent", 1), ("2026-01-07", "salary", 99)],
    )
    pps, _ = summary(spark, dims, ledger, [], "calendar")
    assert rows(pps, "period_label", "category_name", "running_total") == [
        ("2025-12", "Groceries", M(15)),
        ("2025-12", "Rent", M(15)),
        ("2026-01", "Rent", M(16)),
        ("2026-01", "Salary", M(99)),
    ]
    assert rows(plans.fct_monthly_summary(pps)) == rows(pps)


def test_unknown_mode_is_refused(spark, dims):
    with pytest.raises(ValueError):
        summary(spark, dims, txns(spark, []), [], "weekly")


def test_daily_and_row_staging_agree(spark, dims):
    rng = random.Random(1)
    names = ["rent", "groceries", "salary", "travel fund"]
    day = lambda: (date(2026, 1, 1) + timedelta(days=rng.randrange(150))).isoformat()
    ledger = txns(spark, [(rng.choice("ab"), day(), rng.choice(names), rng.randrange(1, 500)) for _ in range(400)])
    periods = pay_periods(pay_dates(spark, ["2026-02-10", "2026-03-12", "2026-04-13"]))
    stg_c = stg_categories(dims["categories"], dims["types"])
    for mode in ("payday", "calendar"):
        by_row = plans.fct_pay_period_summary(plans.stg_transactions(ledger, date_dim(spark), periods), stg_c, mode)
        by_day = plans.fct_pay_period_summary(plans.stage_daily(ledger, date_dim(spark), periods), stg_c, mode)
        assert rows(by_row) == rows(by_day)
        assert by_day.agg(F.sum("total_amount")).first()[0] == ledger.agg(F.sum("amount")).first()[0]


def test_dates_outside_the_dimension_are_dropped(spark, dims):
    ledger = txns(spark, [("2024-12-31", "rent", 10), ("2025-01-01", "rent", 5)])
    staged = plans.stg_transactions(ledger, date_dim(spark), None)
    row = staged.first()
    assert staged.count() == 1 and row["description"] == "No description"
    assert (row["calendar_year"], row["year_month"], row["pay_period_start"]) == (2025, "2025-01", None)


def test_savings_rates(spark, dims):
    ledger = txns(
        spark,
        [("2026-01-02", "salary", 1000), ("2026-01-03", "rent", 333.33), ("2026-01-04", "travel fund", 100),
         ("2026-02-03", "rent", 50), ("2026-03-03", "salary", 200), ("2026-04-03", "rent", 80)],
    )
    pps, _ = summary(spark, dims, ledger, [], "calendar")
    assert rows(
        plans.fct_savings_rate(pps),
        "period_label", "net_income", "remaining_after_savings", "net_savings_rate_pct",
        "explicit_savings_rate_pct", "avg_expenses_3_periods",
    ) == [
        ("2026-01", M(666.67), M(566.67), 66.7, 10.0, 333.33),
        ("2026-02", M(-50), M(-50), 0.0, 0.0, 383.33 / 2),
        ("2026-03", M(200), M(200), 100.0, 0.0, 383.33 / 3),
        ("2026-04", M(-80), M(-80), 0.0, 0.0, 130.0 / 3),
    ]
    assert plans.fct_savings_rate(pps, year=2025).count() == 0


def test_budgets_against_every_overlapping_period(spark, dims):
    ledger = txns(spark, [("2026-03-05", "rent", 90), ("2026-04-20", "groceries", 40), ("2026-05-20", "rent", 101)])
    pps, stg_c = summary(spark, dims, ledger, [], "calendar")
    plan = budgets(
        spark,
        [("1", "fixed", "rent", "2026-04-01", None, 100), ("2", "variable", "groceries", "2026-04-10", None, 0),
         ("3", "fixed", "rent", "2026-01-01", "2026-04-01", 70), ("4", "variable", None, "2026-01-01", None, 500)],
    )
    assert rows(
        plans.fct_budget_vs_actual(pps, plan, stg_c),
        "fiscal_month", "category_name", "actual_amount", "variance", "utilisation_pct", "transaction_count", "budget_status",
    ) == [
        ("2026-04", "Groceries", M(40), M(-40), 0.0, 1, "over_budget"),
        ("2026-04", "Rent", M(0), M(100), 0.0, 0, "within_budget"),
        ("2026-05", "Groceries", M(0), M(0), 0.0, 0, "near_budget"),
        ("2026-05", "Rent", M(101), M(-1), 101.0, 1, "over_budget"),
    ]


def test_group_summary_adds_category_and_envelope_budgets(spark, dims):
    ledger = txns(spark, [("2026-04-05", "rent", 90), ("2026-04-20", "groceries", 40), ("2026-04-20", "salary", 9)])
    pps, _ = summary(spark, dims, ledger, [], "calendar")
    plan = budgets(spark, [("1", "fixed", "rent", "2026-04-01", None, 60), ("2", "fixed", None, "2026-04-01", None, 40)])
    assert rows(
        plans.fct_expense_group_summary(pps, plan, dims["types"]),
        "expense_group", "total_actual", "total_budget", "over_under", "utilisation_pct", "budget_status",
    ) == [
        ("fixed", M(90), M(100), M(-10), 90.0, "near_limit"),
        ("variable", M(40), None, None, 0.0, "on_track"),
    ]


def test_budget_view_keeps_budgets_without_spend(spark, dims):
    ledger = txns(spark, [("2026-03-05", "rent", 90), ("2026-04-05", "rent", 30), ("2026-04-07", "rent", 3)])
    plan = budgets(spark, [("1", "fixed", "rent", "2026-04-01", None, 100), ("2", "variable", "groceries", "2026-04-01", None, 50)])
    assert rows(plans.v_budget_vs_actual(plan, dims["categories"], ledger)) == [
        ("a", None, "Groceries", M(50), M(0), M(50), 0.0),
        ("a", D("2026-04-01"), "Rent", M(100), M(33), M(67), 33.0),
    ]


def test_monthly_view_and_single_month(spark, dims):
    ledger = txns(spark, [("2026-03-05", "rent", 90), ("2026-03-31", "rent", 31), ("2026-04-01", "rent", 30)])
    view = plans.v_monthly_summary(ledger, dims["categories"], dims["types"])
    assert rows(view) == [
        ("a", D("2026-03-01"), "fixed", "Rent", 2, M(121), 60.5),
        ("a", D("2026-04-01"), "fixed", "Rent", 1, M(30), 30.0),
    ]
    only = plans.v_monthly_summary(ledger, dims["categories"], dims["types"], "2026-03")
    assert rows(only) == rows(view)[:1]


def inputs(spark, dims):
    ledger = txns(spark, [("2026-03-05", "rent", 90), ("2026-04-20", "groceries", 40), ("2026-04-16", "salary", 400)])
    return {
        "transactions": ledger,
        "categories": dims["categories"],
        "types": dims["types"],
        "budgets": budgets(spark, [("1", "fixed", "rent", "2026-01-01", None, 100)]),
        "pay_dates": pay_dates(spark, ["2026-04-16"]),
        "dim_date": date_dim(spark),
    }


@pytest.mark.parametrize("mode", ["payday", "calendar"])
def test_written_marts_equal_the_lazy_ones(spark, dims, mode):
    lazy = plans.build_marts(inputs(spark, dims), mode)
    written = write_marts(spark, inputs(spark, dims), work_dir(spark, "marts"), mode)
    assert set(written) < set(lazy)
    for name, df in written.items():
        assert rows(df) == rows(lazy[name]), name


def test_empty_ledger(spark, dims):
    empty = {**inputs(spark, dims), "transactions": txns(spark, [])}
    assert all(
        df.count() == 0 for name, df in plans.build_marts(empty).items() if name != "stg_categories"
    )
