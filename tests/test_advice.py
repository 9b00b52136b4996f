from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from coffer import plans
from coffer.operators import list_budgets, overwrite_active, resolve_budget, scd2_apply
from conftest import BUDGET, D, M, budgets, rows, txns

REQUEST = (
    "request_id int, account_id string, item_name string, price decimal(12,2), "
    "category_name string, purchase_date date, warning_threshold decimal(4,3)"
)


def ask(spark, data):
    """(price, category[, threshold]) on 2026-07-15, numbered."""
    return spark.createDataFrame(
        [
            (i, "a", "shoes", M(r[0]), r[1], D("2026-07-15"), Decimal(r[2]) if len(r) > 2 else None)
            for i, r in enumerate(data)
        ],
        REQUEST,
    )


def assess(spark, dims, requests, ledger, plan):
    return plans.assess_purchases(requests, ledger, plan, dims["categories"], dims["types"])


def decide(spark, dims, price, spent, budget):
    plan = [] if budget is None else [("1", "variable", None, "2026-01-01", None, budget)]
    ledger = txns(spark, [("2026-07-02", "groceries", spent), ("2026-08-01", "groceries", 77), ("2026-06-30", "shopping", 55)])
    done = assess(spark, dims, ask(spark, [(price, "Shopping")]), ledger, budgets(spark, plan))
    return done.result.first()


def test_purchase_within_the_budget(spark, dims):
    r = decide(spark, dims, 100, 400, 1000)
    assert (r["decision"], r["can_buy_within_budget"]) == ("within_budget", True)
    assert (r["remaining_after_purchase"], r["projected_utilisation_pct"]) == (M(500), 50.0)
    assert r["reason"] == "The purchase fits the variable_envelope budget with $500.00 remaining."
    assert (r["period_start"], r["period_end_exclusive"], r["currency"]) == (D("2026-07-01"), D("2026-08-01"), "AUD")


def test_exactly_at_the_warning_threshold_is_tight(spark, dims):
    r = decide(spark, dims, 100, 800, 1000)
    assert (r["decision"], r["can_buy_within_budget"], r["remaining_after_purchase"]) == ("tight", True, M(100))
    assert r["reason"] == "The purchase fits, but would use 90.0% of the variable_envelope budget."


def test_over_budget(spark, dims):
    r = decide(spark, dims, 100, 950, 1000)
    assert (r["decision"], r["can_buy_within_budget"], r["remaining_after_purchase"]) == ("over_budget", False, M(-50))
    assert r["reason"] == "The purchase would exceed the variable_envelope budget by $50.00."


def test_no_budget_still_sums_the_whole_type(spark, dims):
    r = decide(spark, dims, 100, 400, None)
    assert (r["decision"], r["can_buy_within_budget"], r["budget_amount"]) == ("no_budget", None, None)
    assert (r["spent_so_far"], r["projected_spend"], r["budget_scope"]) == (M(400), M(500), "unbudgeted_category")
    assert r["reason"] == "No monthly budget is configured for Shopping or its variable expense envelope."


def test_zero_budget_is_over_and_has_no_utilisation(spark, dims):
    r = decide(spark, dims, 100, 400, 0)
    assert (r["decision"], r["can_buy_within_budget"], r["projected_utilisation_pct"]) == ("over_budget", False, None)
    assert r["remaining_after_purchase"] == M(-500)


def test_category_budget_wins_and_counts_its_category_only(spark, dims):
    plan = budgets(
        spark,
        [("1", "variable", None, "2026-01-01", None, 1000), ("2", "variable", "shopping", "2026-07-01", None, 200),
         ("3", "variable", "shopping", "2026-01-01", "2026-07-01", 5), ("4", "variable", "shopping", "2026-07-16", None, 9)],
    )
    ledger = txns(spark, [("2026-07-02", "groceries", 400), ("2026-07-03", "shopping", 30)])
    r = assess(spark, dims, ask(spark, [(50, "sHOPPING", "0.500")]), ledger, plan).result.first()
    assert (r["budget_scope"], r["budget_amount"], r["spent_so_far"], r["decision"]) == ("category", M(200), M(30), "within_budget")
    assert r["category"] == "Shopping"


def test_spend_of_a_type_without_spend_in_the_category(spark, dims):
    plan = budgets(spark, [("1", "variable", None, "2026-01-01", None, 1000)])
    ledger = txns(spark, [("2026-07-31", "groceries", 1)])
    assert assess(spark, dims, ask(spark, [(1, "Transport")]), ledger, plan).result.first()["spent_so_far"] == M(1)


def test_rejected_requests(spark, dims):
    done = assess(
        spark, dims, ask(spark, [(0, "Shopping"), (5, "Shopping", "0.4"), (5, "Boats"), (5, "Rent", "1.0")]),
        txns(spark, []), budgets(spark, []),
    )
    assert rows(done.rejects, "request_id", "reasons") == [
        (0, ["price must be positive"]), (1, ["warning_threshold out of range"]), (2, ["unknown category"]),
    ]
    assert [r["request_id"] for r in done.result.collect()] == [3]


def test_overlapping_versions_resume_when_the_later_one_ends(spark):
    plan = budgets(
        spark,
        [("1", "variable", "x", "2026-01-01", "2027-01-01", 10), ("2", "variable", "x", "2026-03-01", "2026-04-01", 20),
         ("3", "variable", "x", "2026-06-01", None, 30), ("4", "variable", "x", "2026-06-01", None, 40),
         ("5", "variable", None, "2026-01-01", None, 50)],
    )
    days = ["2025-12-31", "2026-01-01", "2026-03-15", "2026-04-01", "2026-06-01", "2030-01-01"]
    asked = spark.createDataFrame(
        [("a", "x", "variable", D(d)) for d in days], "account_id string, category_id string, type_id string, purchase_date date"
    )
    found = rows(resolve_budget(asked.union(asked), plan), "purchase_date", "budget_id", "scope")
    assert found == [
        (D("2025-12-31"), None, None), (D("2026-01-01"), "1", "category"), (D("2026-03-15"), "2", "category"),
        (D("2026-04-01"), "1", "category"), (D("2026-06-01"), "4", "category"), (D("2030-01-01"), None, None),
    ]


def change(spark, data):
    return spark.createDataFrame(
        [("a", t, c, D(s), M(x)) for t, c, s, x in data],
        "account_id string, type_id string, category_id string, start_date date, budget_amount decimal(12,2)",
    )


def test_budget_changes_keep_history(spark):
    plan = budgets(
        spark,
        [("1", "fixed", "rent", "2026-01-01", None, 100), ("2", "variable", None, "2026-01-01", None, 500),
         ("3", "fixed", "gym", "2026-03-01", None, 20), ("4", "fixed", "rent", "2025-01-01", "2026-01-01", 90)],
    )
    done = scd2_apply(
        plan,
        change(
            spark,
            [("fixed", "rent", "2026-03-05", 100), ("variable", None, "2026-03-05", 600), ("fixed", "gym", "2026-03-05", 25),
             ("saving", "fund", "2026-03-05", 0), ("income", None, "2026-03-05", -1), ("income", "job", "2026-03-05", 1),
             ("income", "job", "2026-03-06", 2), ("fixed", "tv", "2030-01-01", 3)],
        ),
        D("2026-03-01"),
    )
    assert rows(done.budgets, "type_id", "category_id", "start_date", "end_date", "budget_amount") == sorted(
        [
            ("fixed", "rent", D("2026-01-01"), D("2030-01-01"), M(100)),
            ("variable", None, D("2026-01-01"), D("2026-03-01"), M(500)),
            ("variable", None, D("2026-03-05"), D("2030-01-01"), M(600)),
            ("fixed", "gym", D("2026-03-01"), D("2030-01-01"), M(20)),
            ("fixed", "rent", D("2025-01-01"), D("2026-01-01"), M(90)),
            ("saving", "fund", D("2026-03-05"), D("2030-01-01"), M(0)),
        ],
        key=repr,
    )
    assert rows(done.rejects, "type_id", "category_id", "reasons") == sorted(
        [
            ("income", None, ["budget_amount must not be negative"]),
            ("income", "job", ["several changes of one budget"]),
            ("income", "job", ["several changes of one budget"]),
            ("fixed", "tv", ["end_date must follow start_date"]),
            ("fixed", "gym", ["version would end on or before its first day"]),
        ],
        key=repr,
    )
    per_slot = done.budgets.where("end_date = '2030-01-01'").groupBy("type_id", "category_id").count()
    assert per_slot.where("count > 1").count() == 0
    again = scd2_apply(done.budgets, change(spark, [("variable", None, "2026-03-05", 600)]), D("2026-03-09"))
    assert rows(again.budgets, *done.budgets.columns) == rows(done.budgets)


def test_a_budget_with_two_versions_in_force_is_not_changed(spark):
    plan = budgets(spark, [("1", "fixed", "rent", "2026-01-01", None, 100), ("2", "fixed", "rent", "2026-02-01", None, 120)])
    done = scd2_apply(plan, change(spark, [("fixed", "rent", "2026-03-05", 130)]), D("2026-03-01"))
    assert rows(done.budgets, *plan.columns) == rows(plan)
    assert rows(done.rejects, "category_id", "reasons") == [("rent", ["several versions in force"])]


def test_overwriting_keeps_one_version(spark):
    plan = budgets(spark, [("1", "variable", None, "2026-01-01", None, 500), ("2", "variable", None, "2025-01-01", "2026-01-01", 400)])
    done = overwrite_active(plan, change(spark, [("variable", None, "2026-04-01", 1700), ("fixed", None, "2026-04-01", 9)]))
    assert rows(done, "type_id", "start_date", "end_date", "budget_amount") == [
        ("fixed", D("2026-04-01"), D("2030-01-01"), M(9)),
        ("variable", D("2025-01-01"), D("2026-01-01"), M(400)),
        ("variable", D("2026-04-01"), D("2030-01-01"), M(1700)),
    ]


def test_budget_listing(spark, dims):
    plan = budgets(spark, [("1", "variable", None, "2026-01-01", None, 500), ("2", "fixed", "rent", "2025-01-01", "2026-01-01", 4),
                           ("3", "fixed", None, "2025-01-01", None, 6), ("4", "fixed", "rent", "2026-01-01", None, 5)])
    listed = list_budgets(plan, dims["types"], dims["categories"], include_history=True, order=True)
    assert [(r["id"], r["category_name"], r["status"]) for r in listed.collect()] == [
        ("2", "Rent", "historical"), ("4", "Rent", "active"), ("3", "-- ALL --", "active"), ("1", "-- ALL --", "active"),
    ]
    assert [r["id"] for r in list_budgets(plan, dims["types"], dims["categories"], type_id="fixed", order=True).collect()] == ["4", "3"]


def test_budget_status_uses_the_reference_day(spark, dims):
    plan = budgets(
        spark,
        [("1", "variable", None, "2026-01-01", "2026-03-20", 100), ("2", "variable", None, "2026-03-20", None, 50),
         ("3", "fixed", "rent", "2026-01-01", None, 0)],
    )
    ledger = txns(spark, [("2026-03-02", "groceries", 45), ("2026-04-02", "shopping", 46)])
    status = lambda month, as_of: rows(
        plans.budget_status(ledger, plan, dims["categories"], dims["types"], month, D(as_of)),
        "budget_name", "budget", "actual", "utilisation_pct", "status",
    )
    assert status("2026-03", "2026-03-10") == [("Rent", M(0), M(0), 0.0, "on_track"), ("variable envelope", M(100), M(45), 45.0, "on_track")]
    assert status("2026-03", "2026-05-10")[1] == ("variable envelope", M(50), M(45), 90.0, "on_track")
    assert status("2026-04", "2026-05-10")[1] == ("variable envelope", M(50), M(46), 92.0, "near_budget")
    every = plans.budget_status(ledger, plan, dims["categories"], dims["types"], as_of=D("2026-03-10"))
    assert every.count() == 4 and set(every.columns) >= {"month", "budget_scope", "type"}
