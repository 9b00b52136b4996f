"""Reporting marts over pay periods or calendar months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coffer.functions import fixed_values as fv
from coffer.functions.dates import month_end, month_label, month_start
from coffer.functions.money import band, mean, money, pct, total, total_if
from coffer.keys import KEYS, key_list, shared
from coffer.operators.budgets import active, category_budgets
from coffer.operators.dims import stg_categories
from coffer.operators.periods import pay_periods
from coffer.plans.staging import stage_daily, stg_transactions
from coffer.sources.tables import write_table

PERIOD = ["period_label", "period_start_date", "period_end_date", "period_basis"]


def _running_total(keys: Sequence[str]):
    """Cumulative total per broad class. The default frame ends with the last row of the same
    start, so rows that tie on it share a value. Runs over aggregated rows only."""
    return (
        F.sum("total_amount")
        .over(Window.partitionBy(*keys, "category_type").orderBy("period_start_date"))
        .cast("decimal(18,2)")
    )


def _period_columns(mode: str):
    """What identifies a row's period, and the period columns derived from that.

    Rows are grouped by dates only; labels are formatted once per group.
    """
    month, label = F.col("_month"), month_label("_month")
    if mode == "calendar":
        return {"_month": month_start("transaction_date")}, {
            "period_label": label,
            "period_start_date": month,
            "period_end_date": month_end("_month"),
            "period_basis": F.lit("calendar"),
        }
    start, end = F.col("pay_period_start"), F.col("pay_period_end")
    fallback = F.when(start.isNull(), month_start("transaction_date"))
    return {"pay_period_start": start, "pay_period_end": end, "_month": fallback}, {
        "period_label": F.coalesce(start.cast("string"), label),
        "period_start_date": F.coalesce(start, month),
        "period_end_date": F.coalesce(end, month_end("_month")),
        "period_basis": F.when(start.isNotNull(), "payday").otherwise("calendar_fallback"),
    }


def fct_pay_period_summary(
    staged: DataFrame,
    stg_c: DataFrame,
    mode: str = "payday",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Count, total, average and running total per period and category.

    ``staged`` is the output of :func:`stg_transactions` or, cheaper, :func:`stage_daily`.
    Mode ``payday`` follows pay periods and falls back to calendar months for days outside
    them; ``calendar`` always uses months.
    """
    if mode not in fv.PERIOD_MODES:
        raise ValueError(f"period mode must be one of {fv.PERIOD_MODES}, got {mode!r}")
    keys = key_list(keys)
    counted = (
        F.sum("transaction_count") if "transaction_count" in staged.columns else F.count("*")
    )
    by, derived = _period_columns(mode)
    sums = (
        staged.groupBy(*keys, *[c.alias(name) for name, c in by.items()], "category_id")
        .agg(counted.alias("transaction_count"), total("amount").alias("total_amount"))
        .select(
            *keys,
            *[c.alias(name) for name, c in derived.items()],
            "category_id",
            "transaction_count",
            "total_amount",
        )
    )
    named = sums.join(
        stg_c.select(
            *shared(keys, stg_c), "category_id", "category_name", "category_type", "type_name"
        ),
        [*shared(keys, stg_c), "category_id"],
    )
    return named.select(
        *keys,
        *PERIOD,
        "category_id",
        "category_name",
        "category_type",
        "type_name",
        "transaction_count",
        "total_amount",
        mean("total_amount", "transaction_count").alias("avg_amount"),
        _running_total(keys).alias("running_total"),
    )


def fct_monthly_summary(pps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The period summary with its running total computed afresh."""
    keys = key_list(keys)
    return pps.drop("running_total").withColumn("running_total", _running_total(keys))


def fct_savings_rate(
    pps: DataFrame, keys: Sequence[str] = KEYS, year: int | None = None
) -> DataFrame:
    """Income, expenses, savings and rates per period, with averages over the last three.

    ``year`` keeps the periods that start in it; the averages still see the ones before.
    """
    keys = key_list(keys)
    kind = F.col("category_type")
    totals = pps.groupBy(*keys, *PERIOD).agg(
        total_if(kind == "income", "total_amount").alias("total_income"),
        total_if(kind == "expense", "total_amount").alias("total_expenses"),
        total_if(kind == "saving", "total_amount").alias("total_savings"),
    )
    last_three = (
        Window.partitionBy(*keys).orderBy("period_start_date", "period_label").rowsBetween(-2, 0)
    )
    trailing = lambda c: mean(F.sum(c).over(last_three), F.count(c).over(last_three))
    income, expenses = F.col("total_income"), F.col("total_expenses")
    savings = F.col("total_savings")
    rates = totals.select(
        *keys,
        *PERIOD,
        "total_income",
        "total_expenses",
        "total_savings",
        money(income - expenses).alias("net_income"),
        money(income - expenses - savings).alias("remaining_after_savings"),
        pct(income - expenses, income).alias("net_savings_rate_pct"),
        pct(savings, income).alias("explicit_savings_rate_pct"),
        trailing("total_expenses").alias("avg_expenses_3_periods"),
        trailing("total_income").alias("avg_income_3_periods"),
    )
    return rates if year is None else rates.where(F.year("period_start_date") == year)


def fct_budget_vs_actual(
    pps: DataFrame,
    budgets: DataFrame,
    stg_c: DataFrame,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> DataFrame:
    """Active category budgets against every period they overlap, spent in or not.

    The summary is read once: each period carries its categories' sums in a map (as many
    entries as the ledger has categories), budgets join on the ledger and look theirs up.
    """
    keys = key_list(keys)
    per_category = pps.groupBy(*keys, *PERIOD, "category_id").agg(
        total("total_amount").alias("actual_amount"),
        F.sum("transaction_count").alias("transaction_count"),
    )
    periods = per_category.groupBy(*keys, *PERIOD).agg(
        F.map_from_entries(
            F.collect_list(F.struct("category_id", F.struct("actual_amount", "transaction_count")))
        ).alias("_spent")
    )
    rows = category_budgets(active(budgets, end)).select(
        *keys, "category_id", "start_date", "end_date", "budget_amount"
    )
    named = rows.join(
        stg_c.select(*shared(keys, stg_c), "category_id", "category_name", "category_type"),
        [*shared(keys, stg_c), "category_id"],
    )
    overlap = (F.col("period_end_date") >= F.col("start_date")) & (
        F.col("period_start_date") < F.col("end_date")
    )
    spent = F.try_element_at("_spent", F.col("category_id"))
    grid = periods.join(named, keys).where(overlap).select(
        *keys,
        *PERIOD,
        "category_name",
        "category_type",
        money("budget_amount").alias("budget_amount"),
        "start_date",
        F.coalesce(spent["actual_amount"], F.lit(0).cast("decimal(18,2)")).alias("actual_amount"),
        F.coalesce(spent["transaction_count"], F.lit(0)).cast("bigint").alias("transaction_count"),
    )
    return grid.select(
        *keys,
        F.col("period_label").alias("fiscal_month"),
        *PERIOD[1:],
        "category_name",
        "category_type",
        "budget_amount",
        "actual_amount",
        money(F.col("budget_amount") - F.col("actual_amount")).alias("variance"),
        pct("actual_amount", "budget_amount").alias("utilisation_pct"),
        "transaction_count",
        F.col("start_date").alias("budget_since"),
        band("actual_amount", "budget_amount", fv.MART_STATUSES).alias("budget_status"),
    )


def fct_expense_group_summary(
    pps: DataFrame,
    budgets: DataFrame,
    types: DataFrame,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> DataFrame:
    """Fixed and variable spend per period against the sum of the type's active budgets."""
    keys = key_list(keys)
    actuals = (
        pps.where(F.col("type_name").isin(*fv.EXPENSE_TYPES))
        .groupBy(*keys, *PERIOD, F.col("type_name").alias("expense_group"))
        .agg(
            F.sum("transaction_count").alias("transaction_count"),
            total("total_amount").alias("total_actual"),
        )
    )
    type_names = types.where(F.col("name").isin(*fv.EXPENSE_TYPES)).select(
        *shared(keys, types), F.col("id").alias("type_id"), F.col("name").alias("expense_group")
    )
    planned = (
        active(budgets, end)
        .join(type_names, [*shared(keys, types), "type_id"])
        .groupBy(*keys, "expense_group")
        .agg(total("budget_amount").alias("total_budget"))
    )
    return actuals.join(planned, [*keys, "expense_group"], "left").select(
        *keys,
        F.col("period_label").alias("fiscal_month"),
        *PERIOD[1:],
        "expense_group",
        "transaction_count",
        "total_actual",
        "total_budget",
        money(F.col("total_actual") - F.col("total_budget")).alias("over_under"),
        pct("total_actual", "total_budget").alias("utilisation_pct"),
        band("total_actual", "total_budget", fv.GROUP_STATUSES).alias("budget_status"),
    )


def _base(inputs: Mapping[str, DataFrame], mode: str, keys: Sequence[str]):
    stg_c = stg_categories(inputs["categories"], inputs["types"], keys)
    periods = pay_periods(inputs["pay_dates"], keys) if mode == "payday" else None
    daily = stage_daily(inputs["transactions"], inputs["dim_date"], periods, keys)
    return stg_c, periods, fct_pay_period_summary(daily, stg_c, mode, keys)


def _dependent(
    pps: DataFrame, stg_c: DataFrame, inputs: Mapping[str, DataFrame], keys: Sequence[str]
) -> dict[str, DataFrame]:
    return {
        "fct_monthly_summary": fct_monthly_summary(pps, keys),
        "fct_savings_rate": fct_savings_rate(pps, keys),
        "fct_budget_vs_actual": fct_budget_vs_actual(pps, inputs["budgets"], stg_c, keys),
        "fct_expense_group_summary": fct_expense_group_summary(
            pps, inputs["budgets"], inputs["types"], keys
        ),
    }


def build_marts(
    inputs: Mapping[str, DataFrame], mode: str = "payday", keys: Sequence[str] = KEYS
) -> dict[str, DataFrame]:
    """All staging and mart tables, lazily, from the ledger tables in ``inputs``."""
    keys = key_list(keys)
    stg_c, periods, pps = _base(inputs, mode, keys)
    return {
        "stg_categories": stg_c,
        "stg_transactions": stg_transactions(
            inputs["transactions"], inputs["dim_date"], periods, keys
        ),
        "fct_pay_period_summary": pps,
        **_dependent(pps, stg_c, inputs, keys),
    }


def write_marts(
    spark: SparkSession,
    inputs: Mapping[str, DataFrame],
    path: str,
    mode: str = "payday",
    keys: Sequence[str] = KEYS,
    partition_by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Write the marts below ``path`` and return them as read back.

    The period summary is written first and the other marts are built from the written table:
    the ledger is scanned once, and an executor lost later costs no more than its own tasks.
    Staging stays a view. ``partition_by`` names columns all marts have, such as the keys or
    ``period_basis``.
    """
    keys = key_list(keys)
    stg_c, _, pps = _base(inputs, mode, keys)
    target = lambda name: f"{path.rstrip('/')}/{name}"
    write_table(pps, target("fct_pay_period_summary"), partition_by)
    pps = spark.read.schema(pps.schema).parquet(target("fct_pay_period_summary"))
    written = {"fct_pay_period_summary": pps}
    for name, df in _dependent(pps, stg_c, inputs, keys).items():
        write_table(df, target(name), partition_by)
        written[name] = spark.read.schema(df.schema).parquet(target(name))
    return written
