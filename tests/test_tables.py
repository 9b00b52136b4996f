import re

import pytest
from pyspark.sql import functions as F

from coffer import plans
from coffer.operators import (
    append_transactions, backfill_key, check_copied, check_count, check_distinct_count, check_relationship, check_row_parity,
    check_unique, check_value_set, delete_keys, enrich_transactions, insert_missing, patch, quality_report, stg_categories,
    table_counts, tag_by_name, upsert,
)
from coffer.sources import lookup_id, date_dim, load_ledger, write_table
from coffer.functions.fixed_values import CATEGORIES
from conftest import D, M, budgets, pay_dates, rows, txns

KV = "k string, v int, w string"


def kv(spark, data):
    return spark.createDataFrame(data, KV)


def test_insert_missing_and_upsert(spark):
    target, new = kv(spark, [("a", 1, "x")]), kv(spark, [("a", 9, "y"), ("b", 2, "y"), ("b", 1, "y")])
    assert rows(insert_missing(target, new, ["k"])) == [("a", 1, "x"), ("b", 1, "y")]
    assert rows(upsert(target, new, ["k"])) == [("a", 9, "y"), ("b", 2, "y")]


def test_insert_missing_with_a_partial_conflict_rule(spark):
    plan = budgets(spark, [("1", "variable", None, "2025-01-01", "2026-01-01", 5)])
    new = budgets(spark, [("2", "variable", None, "2026-04-01", None, 7)])
    is_active = F.col("category_id").isNull() & (F.col("end_date") == F.lit(D("2030-01-01")))
    once = insert_missing(plan, new, ["account_id", "type_id"], is_active)
    assert once.count() == 2 and insert_missing(once, new, ["account_id", "type_id"], is_active).count() == 2


def test_patch_and_delete(spark):
    target = kv(spark, [("a", 1, "x"), ("b", 2, "y")])
    done = patch(target, kv(spark, [("a", None, "z"), ("q", 5, "z")]), ["k"])
    assert rows(done.table) == [("a", 1, "z"), ("b", 2, "y")] and rows(done.rejects, "k") == [("q",)]
    gone = delete_keys(target, spark.createDataFrame([("b",), ("q",)], "k string"), ["k"])
    assert rows(gone.table, "k") == [("a",)] and rows(gone.rejects) == [("q",)]


def test_backfill_and_tags(spark):
    groups = spark.createDataFrame([("g1", "fixed")], "id string, name string")
    df = spark.createDataFrame([("a", "fixed"), ("b", "odd")], "name string, expense_group string")
    done = backfill_key(df, groups, {"expense_group": "name"}, "expense_group_id")
    assert rows(done.table, "name", "expense_group_id") == [("a", "g1"), ("b", None)]
    assert rows(done.rejects, "name") == [("b",)]
    tags = spark.createDataFrame([("a", "fixed")], "name string, tag string")
    assert rows(tag_by_name(df, tags, "name", "expense_group", "variable")) == [("a", "fixed"), ("b", "variable")]


def test_lookups_keep_to_their_ledger_and_never_multiply_rows(spark):
    dim = spark.createDataFrame([("a", "x", "2"), ("a", "x", "1"), ("b", "x", "3")], "account_id string, name string, id string")
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "account_id string, label string")
    expected = [("a", "1"), ("b", "3"), ("c", None)]
    assert rows(lookup_id(df, dim, "label", "label_id"), "account_id", "label_id") == expected
    assert rows(backfill_key(df, dim, {"label": "name"}, "label_id").table, "account_id", "label_id") == expected
    tags = dim.withColumnRenamed("id", "tag")
    assert rows(tag_by_name(df, tags, "label", "group", "none"), "account_id", "group") == [("a", "1"), ("b", "3"), ("c", "none")]


def test_append_fills_defaults_and_rejects(spark):
    new = txns(spark, [("2026-01-01", "rent", 5), ("2026-01-02", "rent", 0), ("2026-01-03", None, 5)])
    done = append_transactions(txns(spark, [("2026-01-01", "rent", 1)]), new)
    assert rows(done.table, "amount", "payment_method", "is_recurring", "source") == [
        (M(1), None, None, None), (M(5), "card", False, "manual"),
    ]
    assert rows(done.rejects, "id", "reasons") == [("t1", ["amount must be positive"]), ("t2", ["category_id is required"])]


def test_tables_are_read_with_their_schema(spark, tmp_path):
    plan = budgets(spark, [("1", "fixed", "rent", "2026-01-01", None, 5)]).withColumn("created_at", F.lit(None).cast("timestamp"))
    write_table(plan, str(tmp_path / "budgets"), partition_by=["type_id"])
    (tmp_path / "pay_dates.csv").write_text("account_id,pay_date,source,note\na,2026-01-02,auto,\n")
    loaded = load_ledger(
        spark, {"budgets": str(tmp_path / "budgets"), "pay_dates": str(tmp_path / "pay_dates.csv")},
        columns={"budgets": ["account_id", "type_id", "budget_amount"]},
    )
    assert rows(loaded["budgets"]) == [("a", "fixed", M(5))]
    assert rows(loaded["pay_dates"], "pay_date", "source") == [(D("2026-01-02"), "auto")]


def test_dimensions_per_ledger_and_shared(spark, dims):
    own = spark.createDataFrame([("a", "c", "Mine", "fixed"), ("b", "c", "Theirs", "income")], "account_id string, id string, name string, type_id string")
    ledger = txns(spark, [("a", "2026-01-01", "c", 1), ("b", "2026-01-01", "c", 1), ("z", "2026-01-01", "c", 1)])
    assert rows(enrich_transactions(ledger, own, dims["types"]), "account_id", "category_name", "type_name") == [
        ("a", "Mine", "fixed"), ("b", "Theirs", "income"), ("z", None, None),
    ]
    assert enrich_transactions(ledger, own, dims["types"], "inner").count() == 2
    kinds = {r["category_name"]: r["category_type"] for r in stg_categories(dims["categories"], dims["types"]).collect()}
    assert (kinds["Rent"], kinds["Shopping"], kinds["Salary"], kinds["Travel Fund"]) == ("expense", "expense", "income", "saving")


# --- reports ------------------------------------------------------------------------------


def test_search_is_case_insensitive_newest_first(spark, dims):
    ledger = txns(spark, [(f"2026-01-{d:02d}", "groceries", d) for d in range(1, 29)]).withColumn(
        "description", F.when(F.col("amount") == 3, "other").otherwise(F.concat(F.lit("WoolWorths "), "id"))
    )
    found = plans.search_transactions(ledger, dims["categories"], "woolw", limit=27)
    assert found.count() == 27 and found.where("category = 'Groceries'").count() == 27
    top = plans.search_transactions(ledger, dims["categories"], "w_olw%s")
    assert rows(top, "date")[0] == (D("2026-01-19"),) and top.count() == 10
    with pytest.raises(ValueError):
        plans.list_transactions(ledger, dims["categories"], dims["types"], limit=1001)


def test_pages(spark, dims):
    ledger = txns(spark, [(a, f"2026-0{m}-{d:02d}", "rent", d) for a in "ab" for m in (1, 2) for d in range(1, 11)])
    page = lambda **kw: plans.list_transactions(ledger, dims["categories"], dims["types"], **kw)
    assert rows(page(limit=2, offset=1), "account_id", "transaction_date") == [("a", D("2026-02-09")), ("b", D("2026-02-10"))]
    assert page(year=2026, month=1).count() == 20 and page(year=2026).count() == 40
    assert page(category_id="x").count() == 0
    assert rows(page(limit=1, per=["account_id"]), "account_id", "transaction_date") == [("a", D("2026-02-10")), ("b", D("2026-02-10"))]
    ids = spark.createDataFrame([("t0",), ("t0",), ("zz",)], "id string")
    assert rows(plans.get_transactions(ledger, ids, dims["categories"], dims["types"]), "id", "category_name") == [("t0", "Rent")]


def test_month_reports(spark, dims):
    ledger = txns(spark, [("2026-03-01", "rent", 300), ("2026-03-02", "salary", 1000), ("2026-03-03", "travel fund", 50), ("2026-04-01", "rent", 9)])
    spending = plans.monthly_spending(ledger, dims["categories"], "2026-03", order=True)
    assert [(r["category"], r["total"], r["transaction_count"]) for r in spending.collect()] == [
        ("Salary", M(1000), 1), ("Rent", M(300), 1), ("Travel Fund", M(50), 1),
    ]
    assert plans.monthly_spending(ledger, dims["categories"], "2026-03", "Rent").count() == 1
    assert rows(plans.monthly_totals(ledger, dims["categories"], dims["types"], "2026-03")) == [
        ("a", D("2026-03-01"), M(1000), M(300), M(50), M(700), M(650), 70.0)
    ]
    nested = plans.to_json(plans.to_nested(spending, ["month"], "category", ["total"]), ["month"], "nested")
    assert nested.first()["json"] == '{"Rent":{"total":300.00},"Salary":{"total":1000.00},"Travel Fund":{"total":50.00}}'


def test_listings(spark, dims):
    assert [r["name"] for r in plans.list_types(dims["types"]).collect()] == ["fixed", "variable", "income", "saving"]
    names = [r["category_name"] for r in plans.list_categories(dims["categories"], dims["types"], "saving", order=True).collect()]
    assert names == ["Emergency Fund", "General Savings", "Investment Savings", "Travel Fund"]
    assert [r["keyword"] for r in plans.list_rules(dims["merchant_rules"], dims["categories"], order=True).collect()][:4] == ["ALDI", "COLES", "WOOLWORTHS", "AGL"]
    by_type = plans.categories_by_type(dims["categories"], dims["types"], order=True).collect()
    assert [(r["type_name"], r["category_count"]) for r in by_type] == [("fixed", 6), ("variable", 8), ("income", 4), ("saving", 4)]
    assert by_type[2]["categories"] == ["Freelance", "Investment", "Other Income", "Salary"]
    assert [r["pay_date"] for r in plans.list_pay_dates(pay_dates(spark, ["2026-02-01", "2026-01-01"]), order=True).collect()] == [D("2026-01-01"), D("2026-02-01")]


def test_goals_and_plan(spark):
    goals = spark.createDataFrame(
        [("g1", M(1200), M(0), "active"), ("g2", M(8000), M(2200), "active"), ("g3", M(200), M(1), "active"), ("g4", M(1), M(1), "paused")],
        "id string, target_amount decimal(12,2), current_amount decimal(12,2), status string",
    )
    assert rows(plans.goal_progress(goals), "id", "progress_pct") == [("g1", 0.0), ("g2", 28.0), ("g3", 1.0)]
    plan = budgets(spark, [("1", "fixed", "rent", "2026-04-01", None, 2200), ("2", "variable", None, "2026-04-01", None, 1700),
                           ("3", "fixed", "gym", "2026-04-01", "2026-05-01", 5)])
    income = spark.createDataFrame([("a", M(6760))], "account_id string, income decimal(12,2)")
    assert rows(plans.plan_summary(plan, income)) == [("a", M(2200), M(1700), M(3900), M(2860))]


# --- migration and quality ----------------------------------------------------------------


def legacy(spark, dims, lost=False):
    monthly = spark.createDataFrame([("a", "rent", D("2026-04-01"), M(2200)), ("a", "nope" if lost else "health", D("2026-04-01"), M(5))],
                                    "account_id string, category_id string, year_month date, budget_amount decimal(12,2)")
    grouped = spark.createDataFrame([("a", "g2", D("2026-04-01"), M(1700))],
                                    "account_id string, expense_group_id string, year_month date, budget_amount decimal(12,2)")
    groups = spark.createDataFrame([("g1", "fixed"), ("g2", "variable")], "id string, name string")
    return plans.unify_budgets(monthly, grouped, dims["categories"], groups, dims["types"])


def test_unified_budgets(spark, dims):
    done = legacy(spark, dims)
    assert rows(done.budgets, "type_id", "category_id", "end_date", "budget_amount") == [
        ("fixed", "health", D("2030-01-01"), M(5)), ("fixed", "rent", D("2030-01-01"), M(2200)), ("variable", None, D("2030-01-01"), M(1700)),
    ]
    assert {r["violations"] for r in done.checks.collect()} == {0}
    assert [r[1] for r in rows(legacy(spark, dims, lost=True).checks, "table", "violations")] == [1, 1, 0, 0]


def test_single_checks(spark):
    df = kv(spark, [("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "y"), (None, 5, "y")])
    count = lambda check: check.first()["violations"]
    assert count(check_unique(df, "t", ["k"])) == 1
    assert count(check_unique(df, "t", ["k"], F.col("v") > 1)) == 0
    parent = spark.createDataFrame([("a",)], "id string")
    assert count(check_relationship(df, "t", ["k"], parent, ["id"])) == 1
    assert count(check_count(df, "t", 7)) == 2 and count(check_distinct_count(df, "t", "k", 2)) == 0
    assert count(check_row_parity("t", df, df.where("v > 2"))) == 2
    assert count(check_copied("t", df, df.where("v <> 4"), ["k", "v"])) == 1
    expected = spark.createDataFrame([("a",), ("c",)], "k string")
    assert rows(check_value_set(df.where("k is not null"), "k", expected)) == [("b", "unexpected"), ("c", "missing")]
    assert rows(table_counts({"x": df, "y": parent})) == [("x", 5), ("y", 1)]


# the plan of the seed ledger: ten category budgets, all entered as fixed
SEED_BUDGETS = ["Rent", "Groceries", "Dining Out", "Transport", "Utilities", "Phone & Internet", "Insurance", "Entertainment", "Subscriptions", "Shopping"]


def test_quality_report_flags_budgets_of_the_wrong_type(spark, dims):
    types = dict(CATEGORIES)
    wrong = [(str(i), "fixed", n.lower(), "2026-04-01", None, 100) for i, n in enumerate(SEED_BUDGETS)]
    right = [(i, types[n], *rest) for n, (i, _, *rest) in zip(SEED_BUDGETS, wrong)]
    def failing(plan):
        tables = {**dims, "budgets": budgets(spark, plan), "transactions": txns(spark, [("2026-01-01", "rent", 5)]).withColumn("source", F.lit("manual")),
                  "dim_date": date_dim(spark), "pay_dates": pay_dates(spark, ["2026-01-01"]).withColumn("source", F.lit("auto"))}
        report = quality_report(tables, plans.ledger_rules(tables))
        assert report.count() > 40
        return rows(report.where("violations > 0"), "check", "table", "column", "violations")
    assert failing(wrong) == [("relationship", "budgets", "category_id, type_id", 5)]
    assert failing(right) == []
    twice = right + [("x", "fixed", "rent", "2026-05-01", None, 1), ("y", "variable", None, "2026-05-01", None, 1), ("z", "variable", None, "2026-05-01", None, -1)]
    assert failing(twice) == [
        ("check", "budgets", "budget_amount must not be negative", 1),
        ("unique", "budgets", "one active budget per category", 1),
        ("unique", "budgets", "one active envelope per type", 1),
    ]


def test_upsert_keeps_columns_that_are_not_given(spark):
    target = spark.createDataFrame([(1, "coles", 5, "x")], "id int, keyword string, priority int, note string")
    new = spark.createDataFrame([("coles", 9, None), ("aldi", 1, "n")], "keyword string, priority int, note string")
    got = upsert(target, new, ["keyword"])
    assert rows(got, "id", "keyword", "priority", "note") == [(1, "coles", 9, None), (None, "aldi", 1, "n")]


def test_migration_preflight_counts_every_broken_rule(spark):
    needed = ["Groceries", "Health", "Phone & Internet", "Shopping", "Subscriptions", "Transport", "Utilities"]
    kinds = ["fixed", "variable", "income", "saving"]
    group = "account_id int, id int, name string, type string"
    cat = "account_id int, name string, expense_group_id int, type string"
    groups = [(a, i, n, n) for a in (1, 2) for i, n in enumerate(kinds)]
    cats = [(a, n, 0, "fixed") for a in (1, 2) for n in needed]
    def failing(groups, cats, monthly, shared):
        report = plans.migration_preflight(
            spark.createDataFrame(cats, cat), spark.createDataFrame(groups, group),
            spark.createDataFrame(monthly, "account_id int, category_id int"), spark.createDataFrame(shared, "account_id int, expense_group_id int"),
        )
        assert report.count() == 7
        return rows(report.where("violations > 0"), "check", "table", "column", "violations")
    assert failing(groups, cats, [(1, 1), (2, 1)], [(1, 1), (2, 1)]) == []
    bad_groups = [*groups, (2, 9, "fixed", "fixed"), (1, 8, None, None)]
    bad_cats = [*cats[1:], (2, "Rent", None, "fixed"), (2, "Gym", 7, None), (1, "Car", 1, None)]
    assert failing(bad_groups, bad_cats, [(1, 1), (1, 1)], [(2, 3), (2, 3), (1, 3)]) == [
        ("names", "categories", "name", 1),
        ("names", "expense_groups", "name", 2),
        ("not_null", "categories", "expense_group_id", 1),
        ("relationship", "categories", "account_id, expense_group_id", 1),
        ("same", "categories", "type = group_type", 1),
        ("unique", "monthly_budgets", "account_id, category_id", 1),
        ("unique", "monthly_group_budgets", "account_id, expense_group_id", 1),
    ]
    assert failing([], [], [], []) == [("names", "categories", "name", 1), ("names", "expense_groups", "name", 1)]


def test_quality_report_compares_pay_dates_with_periods(spark):
    paid = pay_dates(spark, ["2026-01-01", "2026-02-01"]).withColumn("source", F.lit("auto"))
    periods = spark.createDataFrame([("2026-01-01", "2026-01-31")], "period_start string, period_end string")
    tables = {"pay_dates": paid, "v_pay_periods": periods}
    report = quality_report(tables, plans.ledger_rules(tables))
    assert rows(report.where("violations > 0"), "check", "table", "violations") == [("row_parity", "pay_dates, v_pay_periods", 1)]


def test_pages_behind_cursors_join_to_the_whole_sorted_list(spark, dims):
    data = [(a, f"2026-01-{1 + i % 3:02d}", "rent", 1 + i) for i in range(17) for a in ("a", "b")] + [("b", "2026-02-01", "rent", 9)]
    ledger = txns(spark, data).withColumn("transaction_date", F.when(F.col("id").isin("t4", "t9", "t20"), None).otherwise(F.col("transaction_date")))
    want = [r.id for r in ledger.orderBy(F.desc("transaction_date"), "id").collect()]
    got, after = [], None
    while True:
        page = plans.list_transactions(ledger, dims["categories"], dims["types"], limit=4, after=after)
        end = plans.page_ends(page).first()
        if end is None:
            break
        got += [r.id for r in page.orderBy(F.desc("transaction_date"), "id").collect()]
        after = tuple(end)
    assert got == want
    lists, ends = {"a": [], "b": []}, None
    for _ in range(7):
        page = plans.list_transactions(ledger, dims["categories"], dims["types"], limit=3, per=["account_id"], after=ends)
        for r in page.orderBy("account_id", F.desc("transaction_date"), "id").collect():
            lists[r.account_id].append(r.id)
        ends = spark.createDataFrame(plans.page_ends(page, ["account_id"]).collect(), "account_id string, transaction_date date, id string")
        if ends.count() < 2:
            break
    for account, ids in lists.items():
        own = [r.id for r in ledger.where(F.col("account_id") == account).orderBy(F.desc("transaction_date"), "id").collect()]
        assert ids[: len(own)] == own


def test_a_cursor_reaches_the_scan(spark, dims, tmp_path):
    txns(spark, [("2026-01-01", "rent", 1), ("2025-01-01", "rent", 2)]).write.parquet(str(tmp_path / "t"))
    page = plans.list_transactions(spark.read.parquet(str(tmp_path / "t")), dims["categories"], dims["types"], after=(D("2025-06-01"), "t0"))
    assert rows(page, "id") == [("t1",)]
    assert "LessThanOrEqual(transaction_date,2025-06-01)" in page._jdf.queryExecution().executedPlan().toString()


def test_migration_preflight_keeps_one_row_per_ledger_in_memory(spark):
    from workload.queries import QUERIES

    report = QUERIES["migration_preflight"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.debug.maxToStringFields", 200)
    try:
        plan = report._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "distinct" not in plan and "bit_or" in plan
    # categories are counted before they meet their groups
    assert all("name#" not in keys for keys in re.findall(r"Aggregate \[([^\]]*)\]", plan))
