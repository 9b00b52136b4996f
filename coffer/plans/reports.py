"""Reports over the ledger and listings of its tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coffer.functions import fixed_values as fv
from coffer.functions.dates import in_month, month_bounds, month_start, reference_day
from coffer.functions.money import band, money, pct, total, total_if
from coffer.keys import KEYS, key_list, ordered, shared, spread_join
from coffer.operators.budgets import active
from coffer.operators.dims import enrich_transactions, stg_categories
from coffer.operators.spend import monthly_category_spend, with_month_spend


def _monthly(txns: DataFrame, month: str | date | None, keys: Sequence[str]) -> DataFrame:
    if month is not None:
        txns = in_month(txns, "transaction_date", month)
    return monthly_category_spend(txns, keys)


def monthly_spending(
    txns: DataFrame,
    categories: DataFrame,
    month: str | date | None = None,
    category: str | None = None,
    keys: Sequence[str] = KEYS,
    order: bool = False,
) -> DataFrame:
    """Total and count per category name; one month or every month. With ``order`` the largest
    total comes first."""
    keys = key_list(keys)
    names = categories.select(
        *shared(keys, categories), F.col("id").alias("category_id"), F.col("name").alias("category")
    )
    if category is not None:
        names = names.where(F.col("category") == F.lit(category))
    spending = (
        _monthly(txns, month, keys)
        .join(names, [*shared(keys, categories), "category_id"])
        .groupBy(*keys, "month", "category")
        .agg(
            total("amount").alias("total"), F.sum("transaction_count").alias("transaction_count")
        )
    )
    return ordered(spending, order, *keys, "month", F.desc("total"), "category")


def monthly_totals(
    txns: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    month: str | date | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Income, expenses, savings and the savings rate of a month, or of every month."""
    keys = key_list(keys)
    dims = stg_categories(categories, types, keys)
    classes = dims.select(*shared(keys, dims), "category_id", "category_type")
    kind = F.col("category_type")
    sums = (
        _monthly(txns, month, keys)
        .join(classes, [*shared(keys, dims), "category_id"])
        .groupBy(*keys, "month")
        .agg(
            total_if(kind == "income", "amount").alias("total_income"),
            total_if(kind == "expense", "amount").alias("total_expenses"),
            total_if(kind == "saving", "amount").alias("total_savings"),
        )
    )
    net = F.col("total_income") - F.col("total_expenses")
    return sums.select(
        *keys,
        "month",
        "total_income",
        "total_expenses",
        "total_savings",
        money(net).alias("net_after_expenses"),
        money(net - F.col("total_savings")).alias("remaining_after_savings"),
        pct(net, "total_income").alias("savings_rate_pct"),
    )


def budget_status(
    txns: DataFrame,
    budgets: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    month: str | date | None = None,
    as_of: date | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Budgets in force on the month's reference day against the spend of that month.

    A category budget counts its category, an envelope every category of its type. With
    ``month=None`` every month the ledger has transactions in is reported. ``as_of`` is today
    for the caller and decides the reference day.
    """
    if as_of is None:
        raise ValueError("as_of is required: the day the report is made for")
    keys = key_list(keys)
    if month is None:
        months = txns.select(*keys, month_start("transaction_date").alias("month")).distinct()
        versions = budgets.join(months, keys)
    else:
        first, _ = month_bounds(month)
        txns = in_month(txns, "transaction_date", month)
        versions = budgets.withColumn("month", F.lit(first))
    day = reference_day("month", F.lit(as_of))
    versions = versions.where((F.col("start_date") <= day) & (F.col("end_date") > day))

    type_names = types.select(
        *shared(keys, types), F.col("id").alias("type_id"), F.col("name").alias("type")
    )
    names = categories.select(
        *shared(keys, categories), F.col("id").alias("category_id"), F.col("name").alias("_name")
    )
    single = F.col("category_id").isNotNull()
    joined = (
        with_month_spend(versions, txns, categories, keys)
        .join(type_names, [*shared(keys, types), "type_id"])
        .join(names, [*shared(keys, categories), "category_id"], "left")
        .withColumn(
            "actual", F.when(single, F.col("category_spend")).otherwise(F.col("type_spend"))
        )
    )
    return joined.select(
        *keys,
        "month",
        F.coalesce("_name", F.concat("type", F.lit(" envelope"))).alias("budget_name"),
        F.when(single, "category").otherwise("type_envelope").alias("budget_scope"),
        "type",
        money("budget_amount").alias("budget"),
        "actual",
        pct("actual", "budget_amount").alias("utilisation_pct"),
        band("actual", "budget_amount", fv.REPORT_STATUSES, inclusive=False).alias("status"),
    )


def _newest(
    df: DataFrame, order: list[Column], limit: int, offset: int, per: Sequence[str]
) -> DataFrame:
    """A page of rows: one overall, or with ``per`` one for each value of those columns.

    Overall, Spark keeps the best rows per task and merges those. Per ledger, the rank limit
    is pushed below the shuffle, so a large ledger sends a page per task, not its rows.
    """
    if not per:
        page = df.orderBy(*order)
        return (page.offset(offset) if offset else page).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return (
        df.withColumn("_rank", rank)
        .where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
        .drop("_rank")
    )


def _after(df: DataFrame, after: tuple | DataFrame | None, per: Sequence[str]) -> DataFrame:
    """Rows that come after a cursor in the order of the pages: newest first, then by id.

    The bare comparison of the date reaches the scan, so a page far down reads no newer months.
    """
    if after is None:
        return df
    if isinstance(after, DataFrame):
        if not per:
            raise ValueError("a table of cursors needs the columns that pages are made per")
        ends = after.select(*per, F.struct(F.lit(True).alias("_"), "transaction_date", "id").alias("_end"))
        end, day, last = F.col("_end"), F.col("_end.transaction_date"), F.col("_end.id")
        df = spread_join(df, ends, per, "left")
    else:
        day, last = (F.lit(v) for v in after)
        end = F.lit(True)
        if after[0] is not None:
            df = df.where((F.col("transaction_date") <= day) | F.col("transaction_date").isNull())
    later_id = F.coalesce(F.col("id") > last, last.isNull() & F.col("id").isNotNull())
    older = F.coalesce(F.col("transaction_date") < day, F.col("transaction_date").isNull() & day.isNotNull())
    rest = df.where(end.isNull() | older | (F.col("transaction_date").eqNullSafe(day) & later_id))
    return rest.drop("_end")


def page_ends(page: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The cursor of a page, one for each value of ``per``: ``transaction_date`` and ``id`` of its
    last row. No row for a page without rows. Ids tell the rows of a page apart."""
    place = F.struct(
        F.col("transaction_date").isNull().alias("undated"),
        (-F.unix_date("transaction_date")).alias("age"),
        F.col("id"),
        F.col("transaction_date"),
    )
    ends = page.groupBy(*per).agg(F.max(place).alias("_end")).where(F.col("_end").isNotNull())
    return ends.select(*per, "_end.transaction_date", "_end.id")


def _check_limit(limit: int, most: int | None = None) -> None:
    if limit < 1 or (most is not None and limit > most):
        raise ValueError(f"limit must be between 1 and {most or 'any number'}, got {limit}")


def search_transactions(
    txns: DataFrame,
    categories: DataFrame,
    text: str,
    limit: int = fv.SEARCH_LIMIT,
    keys: Sequence[str] = KEYS,
    per: Sequence[str] = (),
) -> DataFrame:
    """Newest transactions whose description contains the text, in any case.

    ``%`` and ``_`` in the text are wildcards. Names are joined to the page only.
    """
    keys = key_list(keys)
    _check_limit(limit)
    hits = txns.where(F.ilike("description", F.lit(f"%{text}%")))
    page = _newest(hits, [F.desc("transaction_date"), F.asc("id")], limit, 0, per)
    names = categories.select(
        *shared(keys, categories), F.col("id").alias("category_id"), F.col("name").alias("category")
    )
    return page.join(names, [*shared(keys, categories), "category_id"], "left").select(
        *keys,
        "id",
        F.col("transaction_date").alias("date"),
        "amount",
        "category",
        "description",
    )


def list_transactions(
    txns: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    year: int | None = None,
    month: int | None = None,
    category_id=None,
    limit: int = fv.PAGE_SIZE,
    offset: int = 0,
    keys: Sequence[str] = KEYS,
    per: Sequence[str] = (),
    after: tuple | DataFrame | None = None,
) -> DataFrame:
    """A page of transactions, newest first, with names. The month filter needs year and month.

    ``after`` continues behind an earlier page: the (date, id) of its last row, or with ``per``
    the table that :func:`page_ends` makes of it, where a ledger without a row begins anew. Unlike
    with ``offset``, the rows of earlier pages are neither sorted nor kept.
    """
    _check_limit(limit, fv.PAGE_SIZE_MAX)
    if year and month:
        txns = in_month(txns, "transaction_date", date(year, month, 1))
    if category_id is not None:
        txns = txns.where(F.col("category_id") == F.lit(category_id))
    txns = _after(txns, after, per)
    page = _newest(txns, [F.desc("transaction_date"), F.asc("id")], limit, offset, per)
    return enrich_transactions(page, categories, types, "left", keys)


def get_transactions(
    txns: DataFrame,
    ids: DataFrame,
    categories: DataFrame,
    types: DataFrame,
    on: Sequence[str] = ("id",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The transactions of the given ids, with names."""
    return enrich_transactions(
        spread_join(txns, ids.select(*on).distinct(), on, "left_semi"),
        categories,
        types,
        "left",
        keys,
    )


def imported_rows(txns: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Transactions that came from a statement import, of one batch or all."""
    rows = txns.where(F.col("import_batch_id").isNotNull() & (F.col("source") == "bank_import"))
    return rows if batch_id is None else rows.where(F.col("import_batch_id") == batch_id)


def goal_linked(txns: DataFrame) -> DataFrame:
    """Transactions that belong to a savings goal."""
    return txns.where(F.col("savings_goal_id").isNotNull())


def list_types(types: DataFrame) -> DataFrame:
    return types.orderBy("sort_order")


def list_categories(
    categories: DataFrame,
    types: DataFrame,
    type_id=None,
    keys: Sequence[str] = KEYS,
    order: bool = False,
) -> DataFrame:
    """Categories with their type; with ``order`` by name."""
    rows = stg_categories(categories, types, keys)
    if type_id is not None:
        rows = rows.where(F.col("type_id") == F.lit(type_id))
    return ordered(rows, order, "category_name")


def list_rules(
    rules: DataFrame, categories: DataFrame, keys: Sequence[str] = KEYS, order: bool = False
) -> DataFrame:
    """Merchant rules with their category; with ``order`` the strongest first."""
    names = categories.select(
        *shared(keys, categories),
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
    )
    on = [k for k in shared(keys, categories) if k in rules.columns]
    named = rules.join(names, [*on, "category_id"], "left")
    return ordered(named, order, F.desc("priority"), "keyword")


def list_pay_dates(
    pay_dates: DataFrame, keys: Sequence[str] = KEYS, order: bool = False
) -> DataFrame:
    return ordered(pay_dates, order, *key_list(keys), "pay_date")


def list_goals(goals: DataFrame, status: str = "active") -> DataFrame:
    return goals.where(F.col("status") == F.lit(status))


def categories_by_type(
    categories: DataFrame,
    types: DataFrame,
    type_name: str | None = None,
    keys: Sequence[str] = KEYS,
    order: bool = False,
) -> DataFrame:
    """Category names and their number per type; with ``order`` in the order of the types.

    The array holds the categories of one type of one ledger.
    """
    rows = stg_categories(categories, types, keys)
    if type_name is not None:
        rows = rows.where(F.col("type_name") == F.lit(type_name))
    own = shared(key_list(keys), rows)
    counted = rows.groupBy(*own, "type_name", "type_sort_order").agg(
        F.array_sort(F.collect_list("category_name")).alias("categories"),
        F.count("*").alias("category_count"),
    )
    return ordered(counted, order, *own, "type_sort_order")


def goal_progress(goals: DataFrame, status: str = "active") -> DataFrame:
    """Savings goals of a status with progress in whole percent."""
    own = [c for c in goals.columns if c not in ("current_amount", "target_amount", "status")]
    return list_goals(goals, status).select(
        *own,
        money("current_amount").alias("current_amount"),
        money("target_amount").alias("target_amount"),
        pct("current_amount", "target_amount", 0).alias("progress_pct"),
    )


def plan_summary(
    budgets: DataFrame,
    income: DataFrame,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> DataFrame:
    """Active budgets by scope, their sum, and what is left of the expected income.

    ``income`` has keys and ``income``.
    """
    keys = key_list(keys)
    single = F.col("category_id").isNotNull()
    plans = (
        active(budgets, end)
        .groupBy(*keys)
        .agg(
            total_if(single, "budget_amount").alias("fixed_total"),
            total_if(~single, "budget_amount").alias("envelope_total"),
        )
    )
    grand = F.col("fixed_total") + F.col("envelope_total")
    return plans.join(income, keys, "left").select(
        *keys,
        "fixed_total",
        "envelope_total",
        money(grand).alias("grand_total"),
        money(F.col("income") - grand).alias("expected_savings"),
    )


def sheet_balance(
    rows: DataFrame, categories: DataFrame, income_category: str, keys: Sequence[str]
) -> DataFrame:
    """Income, expenses and net of unpivoted sheet rows, one row per sheet."""
    own = shared(keys, categories)
    names = categories.select(*own, F.col("id").alias("category_id"), F.col("name").alias("_name"))
    income = F.col("_name") == F.lit(income_category)
    sums = (
        rows.join(names, [*own, "category_id"], "left")
        .groupBy(*keys)
        .agg(
            total_if(income, "amount").alias("income"),
            total_if(~income, "amount").alias("expenses"),
            F.count("*").alias("transaction_count"),
        )
    )
    return sums.withColumn("net", money(F.col("income") - F.col("expenses")))


def reconcile(
    parts: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    tolerance=fv.RECONCILE_TOLERANCE,
) -> DataFrame:
    """Compare the sum of the parts with a stated total, per key.

    ``parts``: keys, amount. ``totals``: keys, stated_total; keys without one, or with zero,
    are not compared. ``matches`` is false beyond the tolerance.
    """
    keys = list(keys)
    sums = parts.groupBy(*keys).agg(total("amount").alias("_sum"))
    stated = totals.where(F.col("stated_total").isNotNull() & (F.col("stated_total") != 0))
    compared = stated.join(sums, keys, "left").select(
        *keys,
        money("stated_total").alias("stated_total"),
        F.coalesce("_sum", F.lit(0).cast("decimal(18,2)")).alias("parts_total"),
    )
    gap = money(F.col("stated_total") - F.col("parts_total"))
    return compared.withColumn("difference", gap).withColumn(
        "matches", F.abs("difference") <= F.lit(tolerance)
    )


def to_nested(
    df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], out: str = "nested"
) -> DataFrame:
    """One row per key with a map from ``name`` to a struct of ``values``.

    For report-sized inputs: a map holds the names of one key (categories of a month, ...).
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(name), F.struct(*values))))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias(out))


def to_json(df: DataFrame, keys: Sequence[str], column: str, out: str = "json") -> DataFrame:
    """A nested column as a JSON text."""
    return df.select(*keys, F.to_json(column).alias(out))


