"""Budget versions: the one in force on a day, and changing them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coffer.functions import fixed_values as fv
from coffer.keys import KEYS, key_list, null_safe, ordered, shared
from coffer.operators.validation import budget_rules, validate


def active(budgets: DataFrame, end: date = fv.ACTIVE_END) -> DataFrame:
    """Versions in force: their end date is the open end."""
    return budgets.where(F.col("end_date") == F.lit(end))


def category_budgets(budgets: DataFrame) -> DataFrame:
    return budgets.where(F.col("category_id").isNotNull())


def envelopes(budgets: DataFrame) -> DataFrame:
    return budgets.where(F.col("category_id").isNull())


def budget_segments(budgets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each budget's timeline: from ``day`` on, ``version`` is the one in force, or NULL for none.

    Versions may overlap; the latest start wins, then the greatest id. A category budget is
    known by its category (``type_id`` is NULL), an envelope by its type. Versions of the same
    dates are merged first, so an array holds one budget's history of distinct date ranges.
    """
    keys = key_list(keys)
    slot = [*keys, "category_id", "type_id"]
    versions = (
        budgets.select(
            *keys,
            "category_id",
            F.when(F.col("category_id").isNull(), F.col("type_id")).alias("type_id"),
            "start_date",
            "end_date",
            "id",
            "budget_amount",
        )
        .groupBy(*slot, "start_date", "end_date")
        .agg(F.max(F.struct("id", "budget_amount")).alias("_row"))
    )
    history = versions.groupBy(*slot).agg(
        F.collect_list(F.struct("start_date", "end_date", "_row.*")).alias("_versions")
    )
    starts = lambda v: v["start_date"]
    ends = lambda v: v["end_date"]
    in_force = lambda day: F.array_max(
        F.transform(
            F.filter("_versions", lambda v: (v["start_date"] <= day) & (v["end_date"] > day)),
            lambda v: F.struct(v["start_date"], v["id"], v["budget_amount"]),
        )
    )
    days = F.array_distinct(
        F.concat(F.transform("_versions", starts), F.transform("_versions", ends))
    )
    segments = history.select(*slot, "_versions", F.explode(days).alias("day"))
    return segments.select(*slot, "day", in_force(F.col("day")).alias("version"))


def as_of_budgets(
    days: DataFrame, budgets: DataFrame, keys: Sequence[str] = KEYS, day: str = "purchase_date"
) -> DataFrame:
    """Add ``budget_id``, ``budget_amount`` and ``scope`` to rows at day grain.

    Rows and timelines are merged and each row takes the last segment before it, of its
    category and of its type. One exchange on the ledger serves both lookups, and what others
    a caller adds per ledger; ``days`` has to be distinct, so that a ledger is no longer than
    its categories times its days.
    """
    keys = key_list(keys)
    segments = budget_segments(budgets, keys).select(
        *keys,
        "category_id",
        "type_id",
        F.col("day").alias(day),
        F.struct("version").alias("_segment"),
        F.lit(0).alias("_is_day"),
    )
    merged = days.withColumn("_is_day", F.lit(1)).unionByName(segments, allowMissingColumns=True)

    def latest(slot: str):
        so_far = (
            Window.partitionBy(*keys, slot)
            .orderBy(day, "_is_day")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        own = F.when(F.col(slot).isNotNull(), F.col("_segment"))
        return F.last(own, ignorenulls=True).over(so_far)["version"]

    found = (
        merged.repartition(*keys)
        .withColumn("_category", latest("category_id"))
        .withColumn("_envelope", latest("type_id"))
        .where(F.col("_is_day") == 1)
    )
    version = F.coalesce("_category", "_envelope")
    return found.select(
        *days.columns,
        version["id"].alias("budget_id"),
        version["budget_amount"].alias("budget_amount"),
        F.when(F.col("_category").isNotNull(), "category")
        .when(F.col("_envelope").isNotNull(), "envelope")
        .alias("scope"),
    )


def resolve_budget(
    requests: DataFrame,
    budgets: DataFrame,
    keys: Sequence[str] = KEYS,
    day: str = "purchase_date",
) -> DataFrame:
    """Budget in force for each distinct (ledger, category, type, day) of the requests.

    A category budget wins over the envelope of the type. ``scope`` is ``category``,
    ``envelope`` or NULL for none.
    """
    wanted = requests.select(*key_list(keys), "category_id", "type_id", day).distinct()
    return as_of_budgets(wanted, budgets, keys, day)


class BudgetChange(NamedTuple):
    budgets: DataFrame
    rejects: DataFrame


def scd2_apply(
    budgets: DataFrame,
    changes: DataFrame,
    as_of: date,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> BudgetChange:
    """Apply budget changes as new versions.

    A change has keys, type_id, category_id (NULL for the envelope), start_date, budget_amount
    and optionally id. The same amount as the version in force changes nothing. Otherwise that
    version ends at ``as_of`` and a new one runs from the start date to the open end. Rejected
    are invalid changes, several changes of one budget in a call, changes of a budget with several
    versions in force, and changes that would end a version on or before its first day. Without an id a new version gets one derived from its
    content, so a repeated run gives the same.
    """
    keys = key_list(keys)
    slot = [*keys, "type_id", "category_id"]
    valid, invalid = validate(changes, budget_rules(changes, end))

    payload = [c for c in changes.columns if c not in slot]
    grouped = valid.groupBy(*slot).agg(
        F.count("*").alias("_changes"), F.min(F.struct(*payload)).alias("_change")
    )
    crowded_slots = grouped.where(F.col("_changes") > 1).select(*slot)
    crowded = valid.join(
        crowded_slots, null_safe(valid, crowded_slots, slot), "left_semi"
    ).withColumn("reasons", F.array(F.lit("several changes of one budget")))

    single = grouped.where(F.col("_changes") == 1).select(*slot, "_change.*")
    current = (
        active(budgets, end)
        .groupBy(*slot)
        .agg(F.max(F.struct("start_date", "budget_amount")).alias("_now"), F.count("*").alias("_open"))
        .select(*slot, F.col("_now.start_date").alias("_since"), F.col("_now.budget_amount").alias("_amount"), "_open")
    )
    found = single.join(current, null_safe(single, current, slot), "left").select(
        *[single[c] for c in single.columns], "_since", "_amount", "_open"
    )
    unclear = F.coalesce(F.col("_open") > 1, F.lit(False))
    ambiguous = (
        found.where(unclear)
        .select(*changes.columns)
        .withColumn("reasons", F.array(F.lit("several versions in force")))
    )
    planned = found.where(~unclear)
    unchanged = F.col("_amount").isNotNull() & (F.col("_amount") == F.col("budget_amount"))
    too_early = F.col("_since").isNotNull() & (F.col("_since") >= F.lit(as_of))
    effective = planned.where(~unchanged)
    late = (
        effective.where(too_early)
        .select(*changes.columns)
        .withColumn("reasons", F.array(F.lit("version would end on or before its first day")))
    )
    accepted = effective.where(~too_early)

    to_close = accepted.where(F.col("_since").isNotNull()).select(
        *slot, F.lit(True).alias("_close")
    )
    closed = budgets.join(
        to_close,
        null_safe(budgets, to_close, slot) & (budgets["end_date"] == F.lit(end)),
        "left",
    ).select(
        *[
            F.when(F.col("_close"), F.lit(as_of)).otherwise(budgets[c]).alias(c)
            if c == "end_date"
            else budgets[c]
            for c in budgets.columns
        ]
    )
    content = F.concat_ws("|", *[F.col(c).cast("string") for c in slot], "start_date", "budget_amount")
    opened = accepted.select(
        *slot,
        "start_date",
        F.lit(end).alias("end_date"),
        "budget_amount",
        (F.col("id") if "id" in changes.columns else F.sha2(content, 256)).alias("id"),
    )
    result = closed.unionByName(opened, allowMissingColumns=True)
    rejects = invalid.unionByName(crowded).unionByName(ambiguous).unionByName(late)
    return BudgetChange(result, rejects)


def overwrite_active(
    budgets: DataFrame,
    changes: DataFrame,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
) -> DataFrame:
    """Set amount and start of the version in force without keeping history; open one where
    there is none. ``changes`` as in :func:`scd2_apply`, at most one per budget."""
    keys = key_list(keys)
    slot = [*keys, "type_id", "category_id"]
    new = changes.select(
        *slot, F.col("start_date").alias("_start"), F.col("budget_amount").alias("_amount")
    )
    in_force = budgets["end_date"] == F.lit(end)
    replaced = {"start_date": "_start", "budget_amount": "_amount"}
    updated = budgets.join(new, null_safe(budgets, new, slot) & in_force, "left").select(
        *[
            F.coalesce(F.col(replaced[c]), budgets[c]).alias(c) if c in replaced else budgets[c]
            for c in budgets.columns
        ]
    )
    current = active(budgets, end)
    missing = changes.join(current, null_safe(changes, current, slot), "left_anti")
    return updated.unionByName(
        missing.withColumn("end_date", F.lit(end)), allowMissingColumns=True
    )


def list_budgets(
    budgets: DataFrame,
    types: DataFrame,
    categories: DataFrame,
    include_history: bool = False,
    type_id=None,
    keys: Sequence[str] = KEYS,
    end: date = fv.ACTIVE_END,
    order: bool = False,
) -> DataFrame:
    """Budgets with names and status. Only those in force unless history is asked for. With
    ``order`` in report order: type, categories before the envelope, start date."""
    keys = key_list(keys)
    rows = budgets if include_history else active(budgets, end)
    if type_id is not None:
        rows = rows.where(F.col("type_id") == F.lit(type_id))
    type_names = types.select(
        *shared(keys, types),
        F.col("id").alias("type_id"),
        F.col("name").alias("type_name"),
        F.col("sort_order").alias("type_sort_order"),
    )
    names = categories.select(
        *shared(keys, categories),
        F.col("id").alias("category_id"),
        F.col("name").alias("category_label"),
    )
    named = (
        rows.join(type_names, [*shared(keys, types), "type_id"])
        .join(names, [*shared(keys, categories), "category_id"], "left")
        .select(
            *keys,
            "id",
            "type_id",
            "type_name",
            "type_sort_order",
            "category_id",
            F.when(F.col("category_id").isNull(), fv.ALL_CATEGORIES_LABEL)
            .otherwise(F.col("category_label"))
            .alias("category_name"),
            "start_date",
            "end_date",
            "budget_amount",
            F.when(F.col("end_date") == F.lit(end), "active").otherwise("historical").alias("status"),
        )
    )
    return ordered(
        named, order, *keys, "type_sort_order", F.asc_nulls_last("category_id"), "start_date"
    )
