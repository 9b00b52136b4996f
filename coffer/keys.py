"""Ledger keys.

Every operator works on many ledgers at once: ``keys`` names the columns that tell them apart
and is prepended to each join key, grouping and window partition. Configuration tables
(categories, types, rules) may carry the keys, one set per ledger, or not, one set for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("account_id",)


def key_list(keys: Sequence[str]) -> list[str]:
    keys = list(keys)
    if not keys:
        raise ValueError("keys must name at least one ledger column; see one_ledger()")
    return keys


def shared(keys: Sequence[str], df: DataFrame) -> list[str]:
    """The ledger keys a table carries."""
    return [k for k in keys if k in df.columns]


def one_ledger(df: DataFrame, name: str = "main", key: str = "account_id") -> DataFrame:
    """Give the rows of a single, unkeyed ledger its key column."""
    return df.withColumn(key, F.lit(name))


def ordered(df: DataFrame, order: bool, *columns) -> DataFrame:
    """``df`` sorted by ``columns`` if asked for; a global sort reads its input once more."""
    return df.orderBy(*columns) if order else df


def null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Join condition on columns where NULL equals NULL; Spark plans it as an equi-join."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join of rows with an aggregated right side, safe for keys that many rows share.

    An aggregate already has the partitioning of its keys. A join on just those would run in
    the stage of the aggregate, where adaptive execution cannot split a hot key. Joining on a
    hash of the keys as well gives both sides an exchange of their own; the right side, one row
    per key, is shuffled once more for it. Where it is small enough to broadcast, none is. The
    hash comes first, so that sorting seldom looks at the other keys.
    """
    on = list(on)
    # equal keys of different types have to hash alike, so both take the type of their union
    common = left.select(*on).union(right.select(*on)).schema
    key_hash = F.xxhash64(*[F.col(f.name).cast(f.dataType) for f in common.fields])
    tagged = lambda df: df.withColumn("_spread", key_hash)
    return tagged(left).join(tagged(right), ["_spread", *on], how).drop("_spread")
