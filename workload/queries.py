"""One query per ledger operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer import operators as op
from coffer import plans
from coffer.functions import fixed_values as fv
from coffer.functions.dates import local_date, reference_day, valid_at
from coffer.operators.quality import one_pass, same_tests
from coffer.operators.validation import transaction_rules
from coffer.plans.marts import write_marts
from coffer.session import setting, stored, work_dir
from coffer.sources import (
    day_spine,
    expand_breakdown,
    load_ledger,
    lookup_id,
    parse_statement,
    read_statement,
    unpivot_sheet,
    values,
    with_calendar,
)
from coffer.streaming import import_stream
from workload import mapping as m

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = date(1998, 7, 15)
TODAY = date(2001, 8, 1)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: str):
    return F.array_join(F.array_sort(column), "; ").alias(column)


# --- sources -------------------------------------------------------------------------------


@query
def fiscal_calendar(spark, sf):
    """Calendar and fiscal attributes of every order date."""
    orders = m.ledger(spark, sf).select("id", "transaction_date")
    return with_calendar(orders, "transaction_date")


@query
def activity_per_day(spark, sf):
    """Every day between an account's first and last transaction, with its totals."""
    daily = op.daily_totals(m.ledger(spark, sf)).groupBy("account_id", "transaction_date").agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("amount").cast("decimal(18,2)").alias("amount"),
    )
    span = daily.groupBy("account_id").agg(
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last")
    )
    days = day_spine(span, "first", "last", "transaction_date")
    return days.join(daily, ["account_id", "transaction_date"], "left").select(
        "account_id",
        "transaction_date",
        F.coalesce("transaction_count", F.lit(0)).cast("bigint").alias("transaction_count"),
        F.coalesce("amount", F.lit(0)).cast("decimal(18,2)").alias("amount"),
    )


@query
def parsed_statement(spark, sf):
    ok = parse_statement(m.statement_lines(spark, sf)).ok
    return ok.select(
        "account_id", *m.LINE_ID, "transaction_date", "amount", "raw_description", "is_credit", "balance"
    )


@query
def parsed_statement_rejects(spark, sf):
    rejects = parse_statement(m.statement_lines(spark, sf)).rejects
    return rejects.select(*m.LINE_ID, _joined("reasons"))


@query
def read_statements(spark, sf):
    """Statement files of several accounts read back: quotes and commas in the texts, columns in
    another order than usual."""
    base = work_dir(spark, "statements")
    lines = m.statement_lines(spark, sf)
    text = F.concat(F.lit('"'), "Description", F.lit('", Sydney'))
    lines.select("account_id", "Balance", text.alias("Description"), "Amount", "Date").write.partitionBy(
        "account_id"
    ).options(header=True, escape='"').csv(base)
    return parse_statement(read_statement(spark, base)).ok.select(
        F.col("account_id").cast(lines.schema["account_id"].dataType).alias("account_id"),
        "transaction_date",
        "amount",
        "raw_description",
        "is_credit",
        "balance",
    )


@query
def unpivoted_sheets(spark, sf):
    rows = unpivot_sheet(
        m.sheets(spark, sf), ["account_id", "month"], m.sheet_mapping(spark), m.categories(spark), "month"
    ).ok
    return rows.drop("column")


@query
def unpivoted_sheets_per_account(spark, sf):
    """The same where every account has categories of its own."""
    rows = unpivot_sheet(
        m.sheets(spark, sf),
        ["account_id", "month"],
        m.sheet_mapping(spark),
        m.account_categories(spark, sf),
        "month",
    ).ok
    return rows.drop("column")


@query
def sheet_warnings(spark, sf):
    return unpivot_sheet(
        m.sheets(spark, sf), ["account_id", "month"], m.sheet_mapping(spark), m.categories(spark), "month"
    ).warnings


@query
def sheet_balances(spark, sf):
    rows = unpivot_sheet(
        m.sheets(spark, sf), ["account_id", "month"], m.sheet_mapping(spark), m.categories(spark), "month"
    ).ok
    return plans.sheet_balance(rows, m.categories(spark), "Salary", ["account_id", "month"])


def _breakdown(spark, sf):
    """Order lines as the breakdown of the order's total; cheap orders state no total."""
    parts = m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("label"),
        F.when(F.col("l_returnflag") == "R", "Rent")
        .when(F.col("l_returnflag") == "A", "Groceries")
        .otherwise("Hobbies")
        .alias("category"),
        m.cents("l_extendedprice").alias("amount"),
        F.to_date("l_shipdate").alias("transaction_date"),
        F.col("l_linestatus").alias("description"),
    )
    totals = m.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("label"),
        F.when(F.col("o_totalprice") >= 50000, m.cents("o_totalprice")).alias("stated_total"),
    )
    return parts, totals


@query
def breakdown_transactions(spark, sf):
    parts, totals = _breakdown(spark, sf)
    return expand_breakdown(parts, totals, m.categories(spark), ["label"]).ok


@query
def reconciled_totals(spark, sf):
    parts, totals = _breakdown(spark, sf)
    return plans.reconcile(parts, totals, ["label"], tolerance=Decimal("20000"))


# --- dimensions and staging ----------------------------------------------------------------


@query
def stg_categories(spark, sf):
    return op.stg_categories(m.account_categories(spark, sf), m.types(spark))


@query
def enriched_transactions(spark, sf):
    """Left join: categories exist only for accounts' larger orders' priorities."""
    txns = m.customer_ledger(spark, sf).select("id", "account_id", "category_id", "amount")
    big = m.customer_ledger(spark, sf).where(F.col("amount") >= 250000)
    own = big.select("account_id", F.col("category_id").alias("id")).distinct().join(
        m.categories(spark), "id"
    )
    return op.enrich_transactions(txns, own, m.types(spark), "left")


@query
def enriched_transactions_inner(spark, sf):
    txns = m.customer_ledger(spark, sf).select("id", "account_id", "category_id", "amount")
    big = m.customer_ledger(spark, sf).where(F.col("amount") >= 250000)
    own = big.select("account_id", F.col("category_id").alias("id")).distinct().join(
        m.categories(spark), "id"
    )
    return op.enrich_transactions(txns, own, m.types(spark), "inner")


@query
def pay_periods(spark, sf):
    return m.periods(m.ledger(spark, sf))


@query
def stg_transactions(spark, sf):
    txns = m.ledger(spark, sf)
    staged = plans.stg_transactions(txns, m.calendar(spark), m.periods(txns))
    return staged.drop("created_at", "updated_at", "raw_description", "import_batch_id")


# --- marts ---------------------------------------------------------------------------------


def _summary(spark, sf, mode="payday"):
    txns = m.ledger(spark, sf)
    stg_c = op.stg_categories(m.categories(spark), m.types(spark))
    if mode == "calendar":
        staged = plans.stg_transactions(txns, m.calendar(spark), None)
    else:
        staged = plans.stage_daily(txns, m.calendar(spark), m.periods(txns))
    return plans.fct_pay_period_summary(staged, stg_c, mode), stg_c


@query
def fct_pay_period_summary(spark, sf):
    return _summary(spark, sf)[0]


@query
def fct_pay_period_summary_calendar(spark, sf):
    return _summary(spark, sf, "calendar")[0]


@query
def fct_pay_period_summary_by_customer(spark, sf):
    """The same with a ledger per customer: many small windows."""
    txns = m.customer_ledger(spark, sf)
    stg_c = op.stg_categories(m.categories(spark), m.types(spark))
    staged = plans.stage_daily(txns, m.calendar(spark), m.periods(txns))
    return plans.fct_pay_period_summary(staged, stg_c)


@query
def fct_monthly_summary(spark, sf):
    return plans.fct_monthly_summary(_summary(spark, sf)[0])


@query
def fct_savings_rate(spark, sf):
    return plans.fct_savings_rate(_summary(spark, sf)[0])


@query
def fct_savings_rate_of_year(spark, sf):
    return plans.fct_savings_rate(_summary(spark, sf)[0], year=1999)


@query
def fct_budget_vs_actual(spark, sf):
    pps, stg_c = _summary(spark, sf)
    return plans.fct_budget_vs_actual(pps, m.budgets(spark, sf), stg_c)


@query
def fct_expense_group_summary(spark, sf):
    return plans.fct_expense_group_summary(
        _summary(spark, sf)[0], m.budgets(spark, sf), m.types(spark)
    )


def _inputs(spark, sf):
    txns = m.ledger(spark, sf)
    return {
        "transactions": txns,
        "categories": m.categories(spark),
        "types": m.types(spark),
        "budgets": m.budgets(spark, sf),
        "pay_dates": m.pay_dates(txns),
        "dim_date": m.calendar(spark),
    }


@query
def written_marts(spark, sf):
    """Row counts of the marts as written and read back."""
    return op.table_counts(write_marts(spark, _inputs(spark, sf), work_dir(spark, "marts")))


# --- calendar-month views and reports --------------------------------------------------------


@query
def v_monthly_summary(spark, sf):
    return plans.v_monthly_summary(m.ledger(spark, sf), m.categories(spark), m.types(spark))


@query
def v_monthly_summary_of_month(spark, sf):
    return plans.v_monthly_summary(
        m.ledger(spark, sf), m.categories(spark), m.types(spark), "1997-03"
    )


@query
def v_budget_vs_actual(spark, sf):
    return plans.v_budget_vs_actual(m.budgets(spark, sf), m.categories(spark), m.ledger(spark, sf))


@query
def monthly_spending(spark, sf):
    return plans.monthly_spending(m.ledger(spark, sf), m.categories(spark))


@query
def monthly_spending_of_category(spark, sf):
    return plans.monthly_spending(
        m.customer_ledger(spark, sf), m.categories(spark), "1997-03", "Groceries"
    )


@query
def monthly_totals(spark, sf):
    return plans.monthly_totals(m.customer_ledger(spark, sf), m.categories(spark), m.types(spark))


@query
def budget_status(spark, sf):
    return plans.budget_status(
        m.ledger(spark, sf), m.budgets(spark, sf), m.categories(spark), m.types(spark), as_of=AS_OF
    )


@query
def budget_status_of_month(spark, sf):
    return plans.budget_status(
        m.ledger(spark, sf),
        m.budgets(spark, sf),
        m.categories(spark),
        m.types(spark),
        "1998-07",
        AS_OF,
    )


@query
def search_transactions(spark, sf):
    return plans.search_transactions(m.line_ledger(spark, sf), m.brand_categories(spark, sf), "d RiNg")


@query
def search_transactions_per_account(spark, sf):
    return plans.search_transactions(
        m.line_ledger(spark, sf), m.brand_categories(spark, sf), "b%t", limit=5, per=["account_id"]
    )


@query
def list_transactions(spark, sf):
    page = plans.list_transactions(
        m.ledger(spark, sf), m.categories(spark), m.types(spark), limit=100, offset=100
    )
    return page.select("id", "account_id", "transaction_date", "amount", "category_name", "type_name")


@query
def list_transactions_of_month(spark, sf):
    page = plans.list_transactions(
        m.ledger(spark, sf),
        m.categories(spark),
        m.types(spark),
        year=1998,
        month=12,
        category_id="2-HIGH",
        limit=1000,
    )
    return page.select("id", "account_id", "transaction_date", "amount", "category_name", "type_name")


@query
def list_transactions_per_account(spark, sf):
    page = plans.list_transactions(
        m.customer_ledger(spark, sf),
        m.categories(spark),
        m.types(spark),
        limit=3,
        offset=1,
        per=["account_id"],
    )
    return page.select("id", "account_id", "transaction_date", "amount", "category_name", "type_name")


@query
def list_transactions_after(spark, sf):
    """Every customer's second page of two, behind the cursors of the first."""
    ledger = m.customer_ledger(spark, sf)
    page = lambda after: plans.list_transactions(
        ledger, m.categories(spark), m.types(spark), limit=2, per=["account_id"], after=after
    )
    second = page(plans.page_ends(page(None), ["account_id"]))
    return second.select("id", "account_id", "transaction_date", "amount", "category_name", "type_name")


@query
def get_transactions(spark, sf):
    """Transactions of the orders that have a line of the largest quantity."""
    ids = m.table(spark, sf, "lineitem").where(F.col("l_quantity") == 50).select(
        F.col("l_orderkey").alias("id")
    )
    rows = plans.get_transactions(m.ledger(spark, sf), ids, m.categories(spark), m.types(spark))
    return rows.select("id", "account_id", "amount", "category_name", "type_name")


@query
def goal_linked_transactions(spark, sf):
    return plans.goal_linked(m.ledger(spark, sf)).select("id", "account_id", "savings_goal_id", "amount")


@query
def list_pay_dates(spark, sf):
    return plans.list_pay_dates(m.pay_dates(m.customer_ledger(spark, sf)))


@query
def list_categories(spark, sf):
    return plans.list_categories(m.account_categories(spark, sf), m.types(spark), "variable")


@query
def list_rules(spark, sf):
    return plans.list_rules(m.part_rules(spark, sf), m.brand_categories(spark, sf))


@query
def list_budgets(spark, sf):
    rows = op.list_budgets(m.customer_budgets(spark, sf), m.types(spark), m.categories(spark))
    return rows


@query
def list_budgets_with_history(spark, sf):
    return op.list_budgets(
        m.customer_budgets(spark, sf),
        m.types(spark),
        m.categories(spark),
        include_history=True,
        type_id="fixed",
    )


@query
def categories_by_type(spark, sf):
    rows = plans.categories_by_type(m.account_categories(spark, sf), m.types(spark))
    return rows.withColumn("categories", F.array_join("categories", ", "))


@query
def goal_progress(spark, sf):
    return plans.goal_progress(m.goals(spark, sf))


@query
def list_goals(spark, sf):
    return plans.list_goals(m.goals(spark, sf), "paused")


@query
def plan_summary(spark, sf):
    income = m.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"),
        (F.abs(m.cents("c_acctbal")) * 4).cast("decimal(12,2)").alias("income"),
    )
    return plans.plan_summary(m.customer_budgets(spark, sf), income)


@query
def nested_monthly_spending(spark, sf):
    """Spending of each month as JSON, by category."""
    flat = plans.monthly_spending(m.ledger(spark, sf), m.categories(spark))
    nested = plans.to_nested(flat, ["account_id", "month"], "category", ["total", "transaction_count"])
    return plans.to_json(nested, ["account_id", "month"], "nested")


# --- purchase advice and budget versions -----------------------------------------------------


def _assessed(spark, sf):
    return plans.assess_purchases(
        m.purchase_requests(spark, sf),
        m.ledger(spark, sf),
        m.budgets(spark, sf),
        m.categories(spark),
        m.types(spark),
    )


@query
def assess_purchases(spark, sf):
    return _assessed(spark, sf).result


@query
def assess_purchases_rejects(spark, sf):
    return _assessed(spark, sf).rejects.select("request_id", "category_name", _joined("reasons"))


@query
def resolved_budgets(spark, sf):
    """Budget in force for each account, category and day with a transaction."""
    kinds = m.categories(spark).select(F.col("id").alias("category_id"), "type_id")
    asked = m.ledger(spark, sf).join(kinds, "category_id").withColumnRenamed(
        "transaction_date", "purchase_date"
    )
    return op.resolve_budget(asked, m.budgets(spark, sf))


@query
def budgets_in_force(spark, sf):
    return valid_at(m.customer_budgets(spark, sf), F.lit(date(1998, 1, 1)))


@query
def reference_days(spark, sf):
    """Reference day of the month of every transaction."""
    return m.ledger(spark, sf).select(
        "id", reference_day("transaction_date", F.lit(AS_OF)).alias("reference_day")
    )


@query
def scd2_budgets(spark, sf):
    return op.scd2_apply(m.customer_budgets(spark, sf), m.budget_changes(spark, sf), TODAY).budgets


@query
def scd2_rejects(spark, sf):
    rejects = op.scd2_apply(
        m.customer_budgets(spark, sf), m.budget_changes(spark, sf), date(1998, 1, 1)
    ).rejects
    return rejects.select("account_id", "id", "type_id", "category_id", _joined("reasons"))


@query
def overwritten_budgets(spark, sf):
    changes = m.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"),
        (F.col("c_custkey") * 10 + 6).alias("id"),
        F.when(F.col("c_custkey") % 2 == 0, "variable").otherwise("income").alias("type_id"),
        F.lit(None).cast("string").alias("category_id"),
        F.lit(date(2001, 4, 1)).alias("start_date"),
        F.lit(1700).cast("decimal(12,2)").alias("budget_amount"),
    )
    return op.overwrite_active(m.customer_budgets(spark, sf), changes)


# --- pay dates -------------------------------------------------------------------------------


def _detected(spark, sf):
    """Detection with confirmed dates: the day of each account's largest orders."""
    txns = m.ledger(spark, sf)
    confirmed = (
        txns.where(F.col("amount") >= 490000)
        .select("account_id", F.col("transaction_date").alias("pay_date"))
        .distinct()
    )
    return op.detect_pay_dates(txns, confirmed, m.SALARY, m.SALARY_MIN)


@query
def detect_pay_dates(spark, sf):
    return _detected(spark, sf).new_dates


@query
def detect_pay_dates_summary(spark, sf):
    return _detected(spark, sf).summary


@query
def salary_dates_not_near_confirmed(spark, sf):
    """Salary dates without a confirmed date within 60 days before or after, by customer."""
    txns = m.customer_ledger(spark, sf)
    dates = lambda df: df.select("account_id", F.col("transaction_date").alias("pay_date")).distinct()
    confirmed = dates(txns.where(F.col("category_id") == "5-LOW"))
    return op.not_near(dates(txns.where(F.col("category_id") == m.SALARY)), confirmed, 60)


@query
def local_days(spark, sf):
    """Sydney calendar day of every event."""
    return m.table(spark, sf, "events").select(
        "event_id", local_date("ts").alias("local_day")
    )


# --- statement import ------------------------------------------------------------------------


def _import(spark, sf):
    return plans.import_statement(
        m.statement_lines(spark, sf),
        m.rules(spark),
        m.statement_ledger(spark, sf),
        "20020101_bank",
        m.LINE_ID,
        inline_rules=True,
    )


@query
def import_statement_inserted(spark, sf):
    return _import(spark, sf).inserted


@query
def import_statement_duplicates(spark, sf):
    return _import(spark, sf).duplicates


@query
def import_statement_review(spark, sf):
    return _import(spark, sf).review


@query
def import_statement_rejects(spark, sf):
    return _import(spark, sf).rejects.select(*m.LINE_ID, _joined("reasons"))


@query
def import_statement_summary(spark, sf):
    return _import(spark, sf).summary


@query
def imported_ledger_rows(spark, sf):
    """The ledger after an import, reduced to what imports brought in."""
    done = _import(spark, sf).inserted.drop(*m.LINE_ID)
    ledger = m.statement_ledger(spark, sf).withColumn("source", F.lit("manual"))
    return plans.imported_rows(ledger.unionByName(done, allowMissingColumns=True)).select(
        "account_id", "transaction_date", "amount", "raw_description", "category_id"
    )


@query
def categorised_lines(spark, sf):
    """Category of every line by a short rule list."""
    return op.categorise(m.line_ledger(spark, sf).drop("category_id"), m.rules(spark), "description", inline=True).select(
        "id", "description", "category_id"
    )


@query
def categorised_lines_by_join(spark, sf):
    """The same through the rule join that long rule lists take."""
    return op.categorise(
        m.line_ledger(spark, sf).drop("category_id"), m.rules(spark), "description"
    ).select("id", "description", "category_id")


@query
def categorised_documents(spark, sf):
    """Category of every document, or NULL, by a rule per benchmark item, over whole texts."""
    return op.categorise(
        m.table(spark, sf, "documents").select("doc_id", "text"),
        m.table(spark, sf, "benchmark").select(
            F.regexp_extract("text", r"(\w+)\W*$", 1).alias("keyword"),
            F.col("item_id").alias("category_id"),
            F.length("text").alias("priority"),
        ),
        "text",
    ).select("doc_id", "category_id")


@query
def deduplicated_lines(spark, sf):
    batch = m.line_ledger(spark, sf).select(
        "id",
        F.lit(1).alias("account_id"),
        F.trunc("transaction_date", "MM").alias("transaction_date"),
        F.round(F.col("amount"), -3).cast("decimal(12,2)").alias("amount"),
        F.col("description").alias("raw_description"),
    )
    ledger = m.statement_ledger(spark, sf).select(
        F.lit(1).alias("account_id"),
        F.trunc("transaction_date", "MM").alias("transaction_date"),
        F.round(F.col("amount") * 10, -3).cast("decimal(12,2)").alias("amount"),
        "raw_description",
    )
    return op.dedup_new(batch, ledger, order=["id"])


#: tasks that write statement files, and files that a task has open before it sorts its rows
_WRITERS = 200


def _streamed(spark, sf, runs: int) -> str:
    """Statement files of all accounts imported by the stream onto the ledger of earlier imports,
    a few files per batch; each run has a checkpoint of its own, so it sees all files again."""
    base = work_dir(spark, "statement-stream")
    lines = m.statement_lines(spark, sf)
    # a file per account; of few accounts, few share a task
    files = lines.repartition(_WRITERS, "account_id").write.partitionBy("account_id")
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(_WRITERS)):
        files.options(header=True, escape='"').csv(f"{base}/in")
    ledger = stored(m.statement_ledger(spark, sf), "statement-ledger")
    for run in range(runs):
        import_stream(
            spark,
            f"{base}/in",
            f"{base}/ledger",
            f"{base}/checkpoint-{run}",
            m.rules(spark),
            ledger,
            schema=lines.schema,
            row_id=m.LINE_ID,
            max_files_per_trigger=4,
            inline_rules=True,
        ).awaitTermination()
    return base


@query
def streamed_statement_import(spark, sf):
    """What two runs of the stream insert: the second one finds everything known."""
    ledger = spark.read.parquet(f"{_streamed(spark, sf, 2)}/ledger")
    return ledger.select(
        "account_id",
        "transaction_date",
        "category_id",
        "amount",
        "description",
        "payment_method",
        "source",
        "raw_description",
    )


@query
def streamed_statement_reports(spark, sf):
    """Lines the stream did not insert, by what became of them."""
    reports = f"{_streamed(spark, sf, 1)}/ledger-reports"
    tables = [
        spark.read.parquet(f"{reports}/{name}").select(*m.LINE_ID, F.lit(name).alias("outcome"))
        for name in ("duplicates", "review", "rejects")
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


# --- table maintenance -----------------------------------------------------------------------


@query
def insert_missing_days(spark, sf):
    """Pay days of large orders added to those already detected, per customer."""
    txns = m.customer_ledger(spark, sf)
    days = lambda df, source: df.select(
        "account_id", F.col("transaction_date").alias("pay_date"), F.lit(source).alias("source")
    )
    known = days(txns.where(F.col("category_id") == m.SALARY), "auto").distinct()
    new = days(txns.where(F.col("amount") >= 200000), "manual")
    return op.insert_missing(known, new, ["account_id", "pay_date"])


@query
def insert_missing_envelopes(spark, sf):
    """An envelope for each customer, where the type has no active one yet."""
    new = m.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"),
        (F.col("c_custkey") * 10 + 6).alias("id"),
        F.when(F.col("c_custkey") % 2 == 0, "variable").otherwise("saving").alias("type_id"),
        F.lit(None).cast("string").alias("category_id"),
        F.lit(date(2001, 4, 1)).alias("start_date"),
        F.lit(fv.ACTIVE_END).alias("end_date"),
        F.lit(1700).cast("decimal(12,2)").alias("budget_amount"),
    )
    is_envelope = F.col("category_id").isNull() & (F.col("end_date") == F.lit(fv.ACTIVE_END))
    return op.insert_missing(
        m.customer_budgets(spark, sf), new, ["account_id", "type_id"], is_envelope
    )


@query
def upserted_goals(spark, sf):
    """Goals replaced for the customers with large orders, by the sum of those."""
    big = (
        m.customer_ledger(spark, sf)
        .where(F.col("amount") >= 400000)
        .groupBy(F.col("account_id").alias("id"))
        .agg(F.max("amount").cast("decimal(12,2)").alias("target_amount"))
        .withColumn("status", F.lit("active"))
    )
    goals = m.goals(spark, sf).select("id", "account_id", "name", "target_amount", "status")
    return op.upsert(goals, big, ["id"])


def _patched(spark, sf):
    changes = m.customer_ledger(spark, sf).where(F.col("category_id") == "5-LOW").groupBy(
        F.col("account_id").alias("id")
    ).agg(
        F.max("amount").cast("decimal(12,2)").alias("current_amount"),
        F.max(F.when(F.col("amount") > 400000, F.lit("completed"))).alias("status"),
    ).withColumn("id", F.when(F.col("id") % 10 == 0, -F.col("id") - 1).otherwise(F.col("id")))
    return op.patch(m.goals(spark, sf), changes, ["id"])


@query
def patched_goals(spark, sf):
    return _patched(spark, sf).table


@query
def patch_rejects(spark, sf):
    return _patched(spark, sf).rejects


@query
def deleted_transactions(spark, sf):
    """Orders without a returned line: those with one are deleted by key."""
    returned = m.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("id")
    )
    return op.delete_keys(
        m.ledger(spark, sf).select("id", "account_id", "amount"), returned, ["id"]
    ).table


def _appended(spark, sf):
    """Lines as manual entries on top of the orders; some break a rule."""
    new = m.line_ledger(spark, sf).select(
        "id",
        F.lit(0).alias("account_id"),
        "transaction_date",
        F.when(F.col("amount") > 20000, F.lit("2-HIGH")).otherwise(F.lit("3-MEDIUM")).alias("category_id"),
        F.when(F.col("amount") < 2000, F.lit(Decimal("0.00"))).otherwise(F.col("amount")).alias("amount"),
        F.when(F.col("category_id") == "Brand#2", "cheque")
        .when(F.col("category_id") == "Brand#3", "cash")
        .alias("payment_method"),
    )
    target = m.ledger(spark, sf).select(
        F.col("id").cast("string").alias("id"),
        "account_id",
        "transaction_date",
        "category_id",
        "amount",
        "payment_method",
        "is_recurring",
        "source",
    )
    return op.append_transactions(target, new)


@query
def appended_transactions(spark, sf):
    return _appended(spark, sf).table


@query
def append_rejects(spark, sf):
    return _appended(spark, sf).rejects.select("id", _joined("reasons"))


def _backfilled(spark, sf):
    """Category ids of transactions from the category's name; one name is not in the table."""
    names = F.create_map(*[F.lit(x) for row in m.CATEGORY_ROWS for x in row[:2]])
    rows = m.ledger(spark, sf).select("id", "account_id", names[F.col("category_id")].alias("label"))
    known = m.categories(spark).where(F.col("name") != "Shopping")
    return op.backfill_key(rows, known, {"label": "name"}, "category_id")


@query
def backfilled_categories(spark, sf):
    return _backfilled(spark, sf).table


@query
def backfill_unmatched(spark, sf):
    return _backfilled(spark, sf).rejects.select("id", "label")


@query
def tagged_lines(spark, sf):
    """Lines tagged fixed or variable by the name of their part."""
    tags = m.table(spark, sf, "part").where(F.col("p_name").like("%ring")).select(
        F.col("p_name").alias("name"), F.lit("fixed").alias("tag")
    ).distinct()
    lines = m.line_ledger(spark, sf).select("id", "description")
    return op.tag_by_name(lines, tags, "description", "expense_group", "variable")


def _unified(spark, sf):
    """Legacy budgets per customer: one per category, one per group; some name no category."""
    balance = F.abs(m.cents("c_acctbal"))
    customer = m.table(spark, sf, "customer")
    monthly = customer.select(
        F.col("c_custkey").alias("account_id"),
        F.when(F.col("c_custkey") % 20 == 7, "9-NONE").otherwise("2-HIGH").alias("category_id"),
        F.lit(date(2001, 4, 1)).alias("year_month"),
        balance.cast("decimal(12,2)").alias("budget_amount"),
    )
    group_monthly = customer.select(
        F.col("c_custkey").alias("account_id"),
        F.when(F.col("c_custkey") % 2 == 0, "g2").otherwise("g1").alias("expense_group_id"),
        F.lit(date(2001, 4, 1)).alias("year_month"),
        (balance * 2).cast("decimal(12,2)").alias("budget_amount"),
    )
    groups = values(
        spark,
        [("g1", "fixed"), ("g2", "variable"), ("g3", "income"), ("g4", "saving")],
        "id string, name string",
    )
    return plans.unify_budgets(
        monthly, group_monthly, m.categories(spark), groups, m.types(spark)
    )


@query
def unified_budgets(spark, sf):
    return _unified(spark, sf).budgets


@query
def unified_budgets_checks(spark, sf):
    return _unified(spark, sf).checks


@query
def loaded_tables(spark, sf):
    """Orders with their customer's segment, through a load with declared schemas and columns."""
    loaded = load_ledger(
        spark,
        {"orders": f"{sf}/orders.parquet", "customer": f"{sf}/customer.parquet"},
        {"orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double", "customer": "c_custkey bigint, c_name string, c_mktsegment string"},
        {"customer": ["c_custkey", "c_mktsegment"]},
    )
    return loaded["orders"].join(loaded["customer"], F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


# --- data quality ----------------------------------------------------------------------------


@query
def quality_report(spark, sf):
    """All rules over ledger, staging and marts; the ledger breaks some."""
    txns = m.ledger(spark, sf)
    wrong = (
        txns.withColumn("amount", F.col("amount") - 2000)
        .withColumn(
            "category_id",
            F.when(F.col("id") % 100 == 0, F.lit("0-NONE")).otherwise(F.col("category_id")),
        )
        .withColumn(
            "payment_method",
            F.when(F.col("id") % 61 == 0, F.lit("cheque")).otherwise(F.col("payment_method")),
        )
        .withColumn("id", F.col("id") - F.col("id") % 1000 % 2)
    )
    budgets = m.customer_budgets(spark, sf).withColumn(
        "type_id",
        F.when(F.col("account_id") % 5 == 0, F.lit("variable")).otherwise(F.col("type_id")),
    )
    tables = {
        "types": m.types(spark),
        "categories": m.categories(spark),
        "transactions": wrong.drop("savings_goal_id"),
        "budgets": budgets,
        "savings_goals": m.goals(spark, sf),
        "pay_dates": m.pay_dates(txns),
        "dim_date": m.calendar(spark).where(F.col("date") >= F.lit(date(1995, 2, 1))),
        "fct_savings_rate": plans.fct_savings_rate(_summary(spark, sf)[0]),
    }
    return op.quality_report(tables, plans.ledger_rules(tables))


@query
def migration_preflight(spark, sf):
    """A migration's conditions over customers, some of whom lack groups, categories or types."""
    kinds, needed = fv.TYPE_NAMES, sorted({category for _, category, _ in fv.MERCHANT_RULES})
    ids = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"))
    a, name = F.col("account_id"), F.col("name")
    groups = ids.select(a, F.posexplode(F.array(*map(F.lit, kinds))).alias("id", "name"))
    groups = groups.where(~((a % 10 == 3) & (F.col("id") == 3))).unionByName(
        ids.where(a % 10 == 4).select(a, F.lit(9).alias("id"), F.lit("other").alias("name"))
    )
    categories = ids.select(a, F.explode(F.array(*map(F.lit, needed))).alias("name"))
    categories = categories.where(~((a % 13 == 0) & (name == needed[-1]))).select(
        a,
        "name",
        F.when((a % 7 == 0) & (name == needed[1]), None)
        .when((a % 17 == 0) & (name == needed[2]), 9)
        .otherwise(0)
        .alias("expense_group_id"),
        F.when((a % 11 == 0) & (name == needed[0]), "odd").otherwise(kinds[0]).alias("type"),
    )
    orders = m.table(spark, sf, "orders")
    monthly = orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("category_id"))
    shared = orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderstatus").alias("expense_group_id"))
    return plans.migration_preflight(categories, groups.withColumn("type", name), monthly, shared)


@query
def ledger_rejects(spark, sf):
    """Rows that break a rule of the transactions table, with the reasons."""
    rows = m.ledger(spark, sf).select(
        "id",
        "transaction_date",
        F.when(F.col("id") % 40 != 0, F.col("category_id")).alias("category_id"),
        (F.col("amount") - 20000).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("payment_method") == "card", "cheque")
        .otherwise(F.col("payment_method"))
        .alias("payment_method"),
        "source",
    )
    return op.validate(rows, transaction_rules(rows)).rejects.select("id", _joined("reasons"))


@query
def table_counts(spark, sf):
    return op.table_counts(
        {
            "transactions": m.ledger(spark, sf),
            "budgets_total": m.customer_budgets(spark, sf),
            "budgets_per_category": op.category_budgets(m.customer_budgets(spark, sf)),
            "budgets_envelope": op.envelopes(m.customer_budgets(spark, sf)),
            "pay_dates": m.pay_dates(m.ledger(spark, sf)),
            "savings_goals": m.goals(spark, sf),
        }
    )


@query
def count_checks(spark, sf):
    """Row counts, distinct counts and equality of counts."""
    orders, customers = m.table(spark, sf, "orders"), m.table(spark, sf, "customer")
    priorities = len(m.CATEGORY_ROWS)
    return (
        op.check_count(orders, "orders", 1000)
        .unionByName(op.check_distinct_count(orders, "orders", "o_orderpriority", priorities))
        .unionByName(op.check_distinct_count(orders, "orders", "o_custkey", 0))
        .unionByName(op.check_row_parity("orders and customers", orders, customers))
    )


@query
def looked_up_parts(spark, sf):
    """Lines with the id of the first part of their part's name, or NULL for red ones."""
    names = (
        m.table(spark, sf, "part")
        .where(~F.col("p_name").startswith("red"))
        .groupBy(F.col("p_name").alias("name"))
        .agg(F.min("p_partkey").alias("id"))
    )
    lines = m.line_ledger(spark, sf).select("id", F.col("description").alias("part"))
    return lookup_id(lines, names, "part", "part_id")


@query
def unexpected_part_types(spark, sf):
    """Part types compared with the market segments, as a check of a value set."""
    segments = m.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("kind"))
    return op.check_value_set(
        m.table(spark, sf, "part").select(F.col("p_type").alias("kind")), "kind", segments
    )


@query
def mismatched_types(spark, sf):
    """Number of orders whose status differs from that of their lines, NULL-safe."""
    orders = m.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    lines = m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("line_status"),
    )
    joined = orders.join(lines, "o_orderkey")
    return one_pass(joined, "lines", same_tests([("status", "line_status")]))
