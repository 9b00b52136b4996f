"""Ledger tables derived from the driver's tables.

``workload/oracle.py`` repeats each derivation in SQL; the two must agree. All rows of a table
take part, and what is added to them (odd amounts, unknown names, broken text) is a function of
the row.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.operators import detect_pay_dates, pay_periods
from coffer.sources import date_dim, values

SPINE = (date(1995, 1, 1), date(2002, 12, 31))
SALARY = "1-URGENT"
SALARY_MIN = Decimal("300000")

CATEGORY_ROWS = (
    ("1-URGENT", "Salary", "income"),
    ("2-HIGH", "Rent", "fixed"),
    ("3-MEDIUM", "Groceries", "variable"),
    ("4-NOT SPECIFIED", "Shopping", "variable"),
    ("5-LOW", "General Savings", "saving"),
)
TYPE_ROWS = (("fixed", 1), ("variable", 2), ("income", 3), ("saving", 4))

# keyword, category, priority; two rules of equal priority can match one text
RULE_ROWS = (
    ("RING", "3-MEDIUM", 10),
    ("red", "4-NOT SPECIFIED", 5),
    ("BOLT", "2-HIGH", 5),
    ("Gear", "5-LOW", 5),
    ("small w", "1-URGENT", 7),
    ("PLATE", "2-HIGH", 3),
    ("old", "3-MEDIUM", 3),
    ("ANVIL", "4-NOT SPECIFIED", 0),
    ("x", "5-LOW", -1),
)

# slot, type, category, from, to, amount, amount added per nation
BUDGET_ROWS = (
    (1, "fixed", "2-HIGH", date(1995, 1, 1), date(1998, 1, 1), 300000, 10000),
    (2, "fixed", "2-HIGH", date(1998, 1, 1), date(2030, 1, 1), 420000, 15000),
    (3, "variable", "3-MEDIUM", date(1996, 1, 1), date(2030, 1, 1), 0, 30000),
    (4, "variable", None, date(1995, 6, 1), date(1999, 1, 1), 500000, 20000),
    (5, "variable", None, date(1999, 1, 1), date(2030, 1, 1), 900000, 10000),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column) -> Column:
    return F.col(column).cast("decimal(12,2)")


def types(spark: SparkSession) -> DataFrame:
    rows = [(name, name, order) for name, order in TYPE_ROWS]
    return values(spark, rows, "id string, name string, sort_order int")


def categories(spark: SparkSession) -> DataFrame:
    return values(spark, CATEGORY_ROWS, "id string, name string, type_id string")


def rules(spark: SparkSession) -> DataFrame:
    return values(spark, RULE_ROWS, "keyword string, category_id string, priority int")


def calendar(spark: SparkSession) -> DataFrame:
    return date_dim(spark, *SPINE)


def _order_columns(account: str) -> list[Column]:
    status = F.col("o_orderstatus")
    return [
        F.col("o_orderkey").alias("id"),
        F.col(account).alias("account_id"),
        F.to_date("o_orderdate").alias("transaction_date"),
        F.col("o_orderpriority").alias("category_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey")).alias("savings_goal_id"),
        cents("o_totalprice").alias("amount"),
        F.when(status != "P", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias(
            "description"
        ),
        F.when(status == "F", "card")
        .when(status == "O", "transfer")
        .otherwise("direct_debit")
        .alias("payment_method"),
        (F.col("o_orderkey") % 7 == 0).alias("is_recurring"),
        F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("raw_description"),
        F.lit(None).cast("string").alias("import_batch_id"),
    ]


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions; the ledger is the customer's nation: few, very large accounts."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    return table(spark, sf, "orders").join(customer, "o_custkey").select(*_order_columns("c_nationkey"))


def customer_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions; the ledger is the customer: many small accounts."""
    return table(spark, sf, "orders").select(*_order_columns("o_custkey"))


def pay_dates(txns: DataFrame) -> DataFrame:
    return detect_pay_dates(txns, None, SALARY, SALARY_MIN).new_dates


def periods(txns: DataFrame) -> DataFrame:
    return pay_periods(pay_dates(txns))


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Five budget versions per nation."""
    slots = F.array(
        *[
            F.struct(
                F.lit(slot).cast("bigint").alias("slot"),
                F.lit(type_id).alias("type_id"),
                F.lit(category).cast("string").alias("category_id"),
                F.lit(start).alias("start_date"),
                F.lit(end).alias("end_date"),
                F.lit(base).alias("base"),
                F.lit(step).alias("step"),
            )
            for slot, type_id, category, start, end, base, step in BUDGET_ROWS
        ]
    )
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("account_id"))
    return nation.select("account_id", F.inline(slots)).select(
        "account_id",
        (F.col("account_id") * 10 + F.col("slot")).alias("id"),
        "type_id",
        "category_id",
        "start_date",
        "end_date",
        (F.col("base") + F.col("step") * F.col("account_id"))
        .cast("decimal(12,2)")
        .alias("budget_amount"),
    )


def customer_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Three budget versions per customer, sized by the account balance."""
    balance = F.abs(cents("c_acctbal"))
    slot = lambda n, type_id, category, start, end, amount: F.struct(
        (F.col("c_custkey") * 10 + n).alias("id"),
        F.lit(type_id).alias("type_id"),
        F.lit(category).cast("string").alias("category_id"),
        F.lit(start).alias("start_date"),
        F.lit(end).alias("end_date"),
        amount.cast("decimal(12,2)").alias("budget_amount"),
    )
    slots = F.array(
        slot(1, "fixed", "2-HIGH", date(1995, 1, 1), date(1998, 1, 1), balance),
        slot(2, "fixed", "2-HIGH", date(1998, 1, 1), date(2030, 1, 1), balance + 500),
        slot(3, "variable", None, date(1996, 1, 1), date(2030, 1, 1), balance * 2),
    )
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), F.inline(slots)
    )


def budget_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two changes per customer and a third for some: no-ops, versions, envelopes, bad amounts."""
    custkey, balance = F.col("c_custkey"), F.abs(cents("c_acctbal"))
    change = lambda n, type_id, category, start, amount: F.struct(
        (custkey * 10 + n).alias("id"),
        F.lit(type_id).alias("type_id"),
        F.lit(category).cast("string").alias("category_id"),
        start.alias("start_date"),
        amount.cast("decimal(12,2)").alias("budget_amount"),
    )
    rent = F.when(custkey % 3 == 0, balance + 500).when(custkey % 13 == 1, F.lit(-1)).otherwise(
        balance + 700
    )
    start = F.lit(date(2001, 2, 1))
    changes = F.array_compact(
        F.array(
            change(6, "fixed", "2-HIGH", start, rent),
            change(7, "variable", None, start, balance * 3),
            F.when(
                custkey % 11 == 0, change(8, "variable", None, start, balance * 4)
            ),
            change(9, "saving", "5-LOW", F.when(custkey % 17 == 0, F.lit(date(2030, 1, 1))).otherwise(start), balance),
        )
    )
    return table(spark, sf, "customer").select(custkey.alias("account_id"), F.inline(changes))


def purchase_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a proposed purchase, some with an unknown category or no price."""
    names = F.create_map(*[F.lit(x) for row in CATEGORY_ROWS for x in row[:2]])
    key = F.col("id")
    return ledger(spark, sf).select(
        key.alias("request_id"),
        "account_id",
        F.concat(F.lit("Order "), key.cast("string")).alias("item_name"),
        F.when(key % 70 == 1, F.lit(0)).otherwise(F.col("amount")).cast("decimal(12,2)").alias("price"),
        F.when(key % 50 == 0, F.lit("Yacht")).otherwise(F.upper(names[F.col("category_id")])).alias(
            "category_name"
        ),
        F.col("transaction_date").alias("purchase_date"),
        F.when(key % 3 == 0, F.lit(Decimal("0.75")))
        .when(key % 90 == 1, F.lit(Decimal("1.20")))
        .alias("warning_threshold"),
    )


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_ID = [*LINE_KEY, "l_shipdate"]


def statement_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as statement text; the line number of the order is the account."""
    key = F.col("l_orderkey")
    text = F.format_number(F.col("l_quantity") * 100, 2)
    day = F.date_format(F.to_date("l_shipdate"), "d/M/yyyy")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return (
        table(spark, sf, "lineitem")
        .join(part, "l_partkey")
        .select(
            F.col("l_linenumber").alias("account_id"),
            *LINE_KEY,
            F.to_date("l_shipdate").alias("l_shipdate"),
            F.when(key % 97 == 0, F.lit("31/02/2026"))
            .when(key % 97 == 1, F.concat(F.lit(" "), day, F.lit(" ")))
            .otherwise(day)
            .alias("Date"),
            F.when(key % 89 == 0, F.lit("abc"))
            .when(key % 83 == 0, F.lit("0.00"))
            .when(F.col("l_returnflag") == "R", text)
            .otherwise(F.concat(F.lit("-"), text))
            .alias("Amount"),
            F.col("p_name").alias("Description"),
            F.when(key % 79 == 0, F.lit("n/a"))
            .when(key % 5 == 0, F.lit(""))
            .otherwise(F.format_number("l_extendedprice", 2))
            .alias("Balance"),
        )
    )


IMPORTED_UNTIL = date(1997, 1, 1)


def statement_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What earlier imports left in the ledger: the lines shipped before a day."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_shipdate") < F.lit(IMPORTED_UNTIL).cast("timestamp_ntz"))
        .join(part, "l_partkey")
        .select(
            F.col("l_linenumber").alias("account_id"),
            F.to_date("l_shipdate").alias("transaction_date"),
            (F.col("l_quantity") * 100).cast("decimal(12,2)").alias("amount"),
            F.col("p_name").alias("raw_description"),
        )
    )


def line_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as transactions with the part name as description; supplier as account."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return (
        table(spark, sf, "lineitem")
        .join(part, "l_partkey")
        .select(
            F.concat_ws("-", *LINE_KEY).alias("id"),
            F.col("l_suppkey").alias("account_id"),
            F.to_date("l_shipdate").alias("transaction_date"),
            F.col("p_brand").alias("category_id"),
            cents("l_extendedprice").alias("amount"),
            F.col("p_name").alias("description"),
        )
    )


def brand_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Part brands as categories of the line ledger."""
    return (
        table(spark, sf, "part")
        .select(F.col("p_brand").alias("id"), F.concat(F.lit("Parts of "), "p_brand").alias("name"))
        .distinct()
    )


def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One keyword rule per part."""
    return table(spark, sf, "part").select(
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("keyword"),
        F.col("p_brand").alias("category_id"),
        F.col("p_size").alias("priority"),
    )


def account_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's own categories: those of the orders placed."""
    names = F.create_map(*[F.lit(x) for row in CATEGORY_ROWS for x in row[:2]])
    kinds = F.create_map(*[F.lit(x) for row in CATEGORY_ROWS for x in (row[0], row[2])])
    priority = F.col("o_orderpriority")
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_custkey").alias("account_id"),
            priority.alias("id"),
            names[priority].alias("name"),
            kinds[priority].alias("type_id"),
        )
        .distinct()
    )


def goals(spark: SparkSession, sf: str) -> DataFrame:
    """A savings goal per customer."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("account_id"),
        F.col("c_name").alias("name"),
        ((F.col("c_custkey") % 9 + 1) * 1000).cast("decimal(12,2)").alias("target_amount"),
        F.greatest(cents("c_acctbal"), F.lit(Decimal("0.00"))).cast("decimal(12,2)").alias(
            "current_amount"
        ),
        F.when(F.col("c_mktsegment") == "BUILDING", "completed")
        .when(F.col("c_mktsegment") == "MACHINERY", "paused")
        .otherwise("active")
        .alias("status"),
    )


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A wide sheet per customer and month: a column per order priority, empty ones NULL."""
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_custkey").alias("account_id"),
            F.trunc(F.to_date("o_orderdate"), "MM").alias("month"),
            "o_orderpriority",
            cents("o_totalprice").alias("amount"),
        )
        .groupBy("account_id", "month")
        .pivot("o_orderpriority", [row[0] for row in CATEGORY_ROWS])
        .agg(F.sum("amount").cast("decimal(12,2)"))
    )


# sheet column, category, days after the start of the month, text
SHEET_MAPPING = (
    ("1-URGENT", "Salary", 15, "Monthly salary"),
    ("2-HIGH", "Rent", 2, "Monthly rent"),
    ("3-MEDIUM", "Groceries", 5, "Groceries"),
    ("4-NOT SPECIFIED", "Hobbies", 9, "Hobby things"),
    ("5-LOW", "General Savings", 16, "Savings transfer"),
)


def sheet_mapping(spark: SparkSession) -> DataFrame:
    return values(
        spark,
        SHEET_MAPPING,
        "column string, category string, day_offset int, description string",
    )
