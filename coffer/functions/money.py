"""Money expressions. Sums stay decimal; percentages round half up and come out as double."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from coffer.functions.dates import as_col
from coffer.functions.fixed_values import EXPENSE_TYPES, NEAR_LIMIT

MONEY = "decimal(18,2)"


def money(value) -> Column:
    return as_col(value).cast(MONEY)


def total(value) -> Column:
    """Exact sum in the money type."""
    return F.sum(as_col(value)).cast(MONEY)


def total_if(condition: Column, value) -> Column:
    """Sum of the rows that meet a condition, 0 when none does."""
    return F.sum(F.when(condition, as_col(value)).otherwise(F.lit(0).cast("decimal(12,2)"))).cast(MONEY)


def mean(sum_value, count_value) -> Column:
    """Average from an exact sum and a count, so that it can be derived after pre-aggregation."""
    return as_col(sum_value).cast("double") / as_col(count_value)


def ratio_pct(num, den, places: int = 1) -> Column:
    """``num / den`` in percent, rounded half up, as decimal; NULL unless ``den > 0``."""
    num, den = as_col(num), as_col(den)
    return F.when(den > 0, F.round(num.cast(MONEY) * 100 / den.cast(MONEY), places))


def pct(num, den, places: int = 1) -> Column:
    """Like :func:`ratio_pct`, as double, and 0 where there is nothing to divide by."""
    return F.coalesce(ratio_pct(num, den, places).cast("double"), F.lit(0.0))


def band(
    actual,
    budget,
    labels: tuple[str, str, str],
    near: Decimal = NEAR_LIMIT,
    inclusive: bool = True,
) -> Column:
    """Over / near / under label. A NULL budget compares as unknown and falls to the last one."""
    actual, budget = as_col(actual), as_col(budget)
    over, close, under = labels
    limit = budget * F.lit(near)
    near_test = actual >= limit if inclusive else actual > limit
    return F.when(actual > budget, over).when(near_test, close).otherwise(under)


def category_type(type_name) -> Column:
    """Broad class of a type: fixed and variable are both expenses."""
    type_name = as_col(type_name)
    return F.when(type_name.isin(*EXPENSE_TYPES), "expense").otherwise(type_name)
