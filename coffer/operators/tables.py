"""Table maintenance as set operations: insert, upsert, patch, delete, backfill, append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.keys import KEYS, null_safe, shared, spread_join
from coffer.operators.validation import transaction_rules, validate


class Changed(NamedTuple):
    table: DataFrame
    rejects: DataFrame


def one_per_key(df: DataFrame, on: Sequence[str], latest: bool = True) -> DataFrame:
    """One row per key, the greatest (or smallest) by its other columns.

    Unlike ``dropDuplicates`` the choice does not depend on the order in which rows arrive, so
    a recomputed task makes the same one.
    """
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.distinct()
    pick = F.max if latest else F.min
    return (
        df.groupBy(*on)
        .agg(pick(F.struct(*rest)).alias("_row"))
        .select(*[F.col(c) if c in on else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def insert_missing(
    target: DataFrame, new: DataFrame, on: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Add the rows whose key is absent. ``where`` limits the conflict test to some target rows,
    as a partial unique index does; keys compare NULL as equal then."""
    fresh = one_per_key(new, on, latest=False)
    if where is None:
        absent = fresh.join(target.select(*on), list(on), "left_anti")
    else:
        taken = target.where(where).select(*on).distinct()
        absent = fresh.join(taken, null_safe(fresh, taken, on), "left_anti")
    return target.unionByName(absent, allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Overwrite the rows whose key is given, in the columns of ``new``, and add the others.

    Columns that ``new`` lacks keep their value; a NULL in ``new`` overwrites.
    """
    fresh = one_per_key(new, on)
    given = [c for c in fresh.columns if c not in on]
    changes = fresh.select(*on, F.struct(F.lit(True).alias("_"), *given).alias("_new"))
    joined = spread_join(target, changes, on, "left")
    columns = [*target.columns, *(c for c in given if c not in target.columns)]
    value = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")) for c in given}
    value |= {c: value[c].otherwise(F.col(c)) for c in given if c in target.columns}
    kept = joined.select(*[value.get(c, F.col(c)).alias(c) for c in columns])
    added = fresh.join(target.select(*on), list(on), "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def patch(target: DataFrame, changes: DataFrame, on: Sequence[str]) -> Changed:
    """Overwrite with the non-NULL fields of a change; NULL fields leave the value alone.

    Changes without a row to apply to come back as rejects.
    """
    fields = [c for c in changes.columns if c not in on and c in target.columns]
    change = one_per_key(changes, on).select(
        *on, *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    updated = spread_join(target, change, on, "left").select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c)
            for c in target.columns
        ]
    )
    rejects = changes.join(target.select(*on), list(on), "left_anti")
    return Changed(updated, rejects)


def delete_keys(target: DataFrame, keys_df: DataFrame, on: Sequence[str]) -> Changed:
    """Remove the rows whose key is given; keys that match nothing come back as rejects."""
    wanted = keys_df.select(*on).distinct()
    return Changed(
        spread_join(target, wanted, on, "left_anti"),
        wanted.join(target.select(*on), list(on), "left_anti"),
    )


def backfill_key(
    df: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    out: str,
    lookup_id: str = "id",
    keys: Sequence[str] = KEYS,
) -> Changed:
    """Fill ``out`` with the id of the lookup row whose text matches.

    ``on`` maps columns of ``df`` to columns of ``lookup``. A value already in ``out`` is
    overwritten only by a match. A lookup that carries ledger keys is used within the ledger;
    of several rows of one text the least id counts. The rows left without a key come back as
    rejects.
    """
    on = {**{k: k for k in shared(keys, lookup)}, **on}
    named = lookup.select(
        *[F.col(theirs).alias(ours) for ours, theirs in on.items()],
        F.col(lookup_id).alias("_found"),
    )
    ids = named.groupBy(*on).agg(F.min("_found").alias("_found"))
    old = [F.col(out)] if out in df.columns else []
    filled = spread_join(df, ids, list(on), "left").select(
        *[c for c in df.columns if c != out], F.coalesce("_found", *old).alias(out)
    )
    return Changed(filled, filled.where(F.col(out).isNull()))


def tag_by_name(
    df: DataFrame, tags: DataFrame, name: str, tag: str, default: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Label rows by a name list (``name``, ``tag``); names not listed get the default.

    A list that carries ledger keys is used within the ledger; of several tags of one name the
    least counts.
    """
    on = [*shared(keys, tags), name]
    named = tags.select(*shared(keys, tags), F.col("name").alias(name), F.col("tag").alias("_tag"))
    labels = named.groupBy(*on).agg(F.min("_tag").alias("_tag"))
    return (
        spread_join(df.drop(tag), labels, on, "left")
        .withColumn(tag, F.coalesce("_tag", F.lit(default)))
        .drop("_tag")
    )


def append_transactions(target: DataFrame, new: DataFrame) -> Changed:
    """Append manual entries: fill the defaults, validate, add the valid ones."""
    defaults = {
        "payment_method": F.lit("card"),
        "is_recurring": F.lit(False),
        "source": F.lit("manual"),
    }
    filled = new
    for name, value in defaults.items():
        filled = filled.withColumn(
            name, F.coalesce(F.col(name), value) if name in new.columns else value
        )
    ok, rejects = validate(filled, transaction_rules(filled))
    return Changed(target.unionByName(ok, allowMissingColumns=True), rejects)
