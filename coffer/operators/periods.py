"""Pay periods: deriving them, assigning days to them, detecting pay days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coffer.functions import fixed_values as fv
from coffer.keys import KEYS, key_list, shared


def pay_periods(
    pay_dates: DataFrame, keys: Sequence[str] = KEYS, open_end: date = fv.ACTIVE_END
) -> DataFrame:
    """Periods from each pay date to the day before the next one; the last stays open.

    The window runs over the distinct pay dates of one ledger, at most one row per day.
    """
    keys = key_list(keys)
    following = F.lead("pay_date").over(Window.partitionBy(*keys).orderBy("pay_date"))
    return (
        pay_dates.select(*keys, "pay_date")
        .distinct()
        .select(
            *keys,
            F.col("pay_date").alias("period_start"),
            F.coalesce(F.date_sub(following, 1), F.lit(open_end)).alias("period_end"),
        )
    )


def as_of_periods(
    days: DataFrame, periods: DataFrame, keys: Sequence[str] = KEYS, on: str = "transaction_date"
) -> DataFrame:
    """Add ``pay_period_start`` and ``pay_period_end`` to rows at day grain.

    Equal to a left range join on ``start <= day <= end`` for the periods of one ledger, which
    do not overlap. Starts and days are merged into one ordered run per ledger and each day
    takes the last start before it, so a ledger is sorted once instead of being compared with
    all of its periods. Feed pre-aggregated days: a window partition is one whole ledger.
    """
    keys = key_list(keys)
    columns = days.columns
    starts = periods.select(
        *keys,
        F.col("period_start").alias(on),
        F.col("period_start").alias("_start"),
        F.col("period_end").alias("_end"),
        F.lit(0).alias("_is_day"),
    )
    merged = days.withColumn("_is_day", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    so_far = (
        Window.partitionBy(*keys)
        .orderBy(on, "_is_day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = merged.select(
        *columns,
        "_is_day",
        F.last("_start", ignorenulls=True).over(so_far).alias("_start"),
        F.last("_end", ignorenulls=True).over(so_far).alias("_end"),
    ).where(F.col("_is_day") == 1)
    inside = F.col(on) <= F.col("_end")
    return found.select(
        *columns,
        F.when(inside, F.col("_start")).alias("pay_period_start"),
        F.when(inside, F.col("_end")).alias("pay_period_end"),
    )


def assign_periods(
    txns: DataFrame,
    periods: DataFrame,
    keys: Sequence[str] = KEYS,
    on: str = "transaction_date",
    method: str = "as_of",
) -> DataFrame:
    """Left range join of rows with pay periods; rows outside every period get NULLs.

    ``range`` joins on the ledger with the range as a condition. It suits period tables that
    Spark knows to be below its broadcast threshold, since the rows then stay where they are.

    ``as_of`` holds for any size. Only the distinct (ledger, day) pairs pass through the as-of window. The rows meet the
    result in an equi-join on ledger and day, which spreads a large ledger over its days and
    lets adaptive execution split a day that is still too large.
    """
    keys = key_list(keys)
    if method == "range":
        spans = periods.select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            F.col("period_start").alias("pay_period_start"),
            F.col("period_end").alias("pay_period_end"),
        )
        within = F.col(on).between(F.col("pay_period_start"), F.col("pay_period_end"))
        for k in keys:
            within = within & (F.col(k) == F.col(f"_{k}"))
        return txns.join(spans, within, "left").drop(*[f"_{k}" for k in keys])
    if method != "as_of":
        raise ValueError(f"method must be 'as_of' or 'range', got {method!r}")
    days = as_of_periods(txns.select(*keys, on).distinct(), periods, keys, on)
    return txns.join(days, [*keys, on], "left")


class Detected(NamedTuple):
    new_dates: DataFrame
    summary: DataFrame


def detect_pay_dates(
    txns: DataFrame,
    pay_dates: DataFrame | None,
    salary,
    min_amount=fv.SALARY_MIN_AMOUNT,
    gap_days: int = fv.PAYDAY_GAP_DAYS,
    keys: Sequence[str] = KEYS,
) -> Detected:
    """Pay dates from salary deposits, at least ``gap_days + 1`` days apart.

    ``salary`` is the id of the salary category or a DataFrame of such ids (``category_id``,
    with the keys if categories are per ledger). Deposits near a confirmed pay date are
    dropped first. The rest is walked in date order and a date is accepted if it is far enough
    from the last accepted one, which in ascending order is the nearest.

    The walk folds over the distinct dates of one ledger, so an array has at most one entry
    per calendar day however many deposits a ledger has.
    """
    keys = key_list(keys)
    deposits = txns.where(F.col("amount") >= F.lit(Decimal(min_amount)))
    if isinstance(salary, DataFrame):
        deposits = deposits.join(salary, [*shared(keys, salary), "category_id"], "left_semi")
    else:
        deposits = deposits.where(F.col("category_id") == F.lit(salary))
    candidates = (
        deposits.groupBy(*keys, F.col("transaction_date").alias("pay_date"))
        .agg(F.count("*").alias("deposits"))
    )
    if pay_dates is None:
        flagged = candidates.withColumn("_near", F.lit(None).cast("boolean"))
    else:
        near = near_dates(candidates, pay_dates, gap_days, keys)
        flagged = candidates.join(near.withColumn("_near", F.lit(True)), [*keys, "pay_date"], "left")

    last = lambda accepted: F.element_at(accepted, -1)
    walked = flagged.groupBy(*keys).agg(
        F.sum("deposits").alias("total_salary_transactions"),
        F.array_sort(
            F.collect_list(F.when(F.col("_near").isNull(), F.col("pay_date")))
        ).alias("_dates"),
    ).select(
        *keys,
        "total_salary_transactions",
        F.aggregate(
            "_dates",
            F.array().cast("array<date>"),
            lambda accepted, d: F.when(
                (F.size(accepted) == 0) | (F.date_diff(d, last(accepted)) > gap_days),
                F.concat(accepted, F.array(d)),
            ).otherwise(accepted),
        ).alias("_accepted"),
    )
    new_dates = walked.select(*keys, F.explode("_accepted").alias("pay_date")).select(
        *keys,
        "pay_date",
        F.lit("auto").alias("source"),
        F.lit(fv.PAY_DATE_NOTE).alias("note"),
    )
    detected = F.size("_accepted").cast("bigint")
    summary = walked.select(
        *keys,
        detected.alias("pay_dates_detected"),
        (F.col("total_salary_transactions") - detected).alias("skipped_near_confirmed"),
        "total_salary_transactions",
    )
    return Detected(new_dates, summary)


def near_dates(
    candidates: DataFrame,
    pay_dates: DataFrame,
    gap_days: int = fv.PAYDAY_GAP_DAYS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The distinct candidate days within ``gap_days`` of a pay date of their ledger.

    Both are merged into one run of distinct days per ledger, where a frame of days looks for a
    pay date; rows are reduced to days before they are shuffled, and nothing is spelled out.
    """
    keys = key_list(keys)
    days = [
        df.select(*keys, "pay_date", F.lit(asked).alias("_asked"), F.lit(not asked).alias("_paid"))
        for df, asked in ((candidates, True), (pay_dates, False))
    ]
    merged = (
        days[0]
        .unionByName(days[1])
        .dropna(subset=[*keys, "pay_date"])
        .groupBy(*keys, "pay_date")
        .agg(F.bool_or("_asked").alias("_asked"), F.bool_or("_paid").alias("_paid"))
    )
    day = F.unix_date("pay_date")
    around = Window.partitionBy(*keys).orderBy(day).rangeBetween(-gap_days, gap_days)
    near = merged.withColumn("_near", F.max("_paid").over(around))
    return near.where(F.col("_asked") & F.col("_near")).select(*keys, "pay_date")


def not_near(
    candidates: DataFrame,
    pay_dates: DataFrame,
    gap_days: int = fv.PAYDAY_GAP_DAYS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Candidate dates without a confirmed pay date in the neighbourhood (anti join)."""
    keys = key_list(keys)
    near = near_dates(candidates, pay_dates, gap_days, keys)
    return candidates.join(near, [*keys, "pay_date"], "left_anti")
