"""Data-quality checks. Each yields rows of (check, table, column, violations)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.keys import null_safe


def _row(check: str, table: str, column: str, violations: Column):
    return [
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        violations.cast("bigint").alias("violations"),
    ]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def one_pass(
    df: DataFrame,
    table: str,
    tests: Mapping[tuple[str, str], Column],
    totals: Mapping[tuple[str, str], Column] | None = None,
) -> DataFrame:
    """Any number of row tests in one scan. ``tests``: (check, column) to a condition that is
    true for a violating row; ``totals``: to an aggregate that is the number of violations."""
    found = {**{name: F.count_if(bad) for name, bad in tests.items()}, **(totals or {})}
    counts = df.agg(*[total.alias(f"_{i}") for i, total in enumerate(found.values())])
    rows = F.array(
        *[
            F.struct(*_row(check, table, column, F.col(f"_{i}")))
            for i, (check, column) in enumerate(found)
        ]
    )
    return counts.select(F.inline(rows))


def not_null_tests(columns: Sequence[str]) -> dict[tuple[str, str], Column]:
    return {("not_null", c): F.col(c).isNull() for c in columns}


def accepted_tests(values: Mapping[str, Sequence[str]]) -> dict[tuple[str, str], Column]:
    return {
        ("accepted_values", c): F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
        for c, allowed in values.items()
    }


def rule_tests(rules: Mapping[str, Column]) -> dict[tuple[str, str], Column]:
    """CHECK rules as tests; a rule that is unknown for a row is not broken."""
    return {("check", name): ~rule for name, rule in rules.items()}


def same_tests(pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], Column]:
    """Two columns have to agree; NULL agrees with NULL only."""
    return {("same", f"{a} = {b}"): ~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs}


def check_not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return one_pass(df, table, not_null_tests(columns))


def check_accepted(df: DataFrame, table: str, values: Mapping[str, Sequence[str]]) -> DataFrame:
    return one_pass(df, table, accepted_tests(values))


def check_unique(
    df: DataFrame, table: str, columns: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Number of values that occur more than once among the (selected) rows."""
    rows = df if where is None else df.where(where)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    repeated = (
        rows.where(complete)
        .groupBy(*columns)
        .agg(F.count("*").alias("_rows"))
        .agg(F.count_if(F.col("_rows") > 1).alias("_repeated"))
    )
    return repeated.select(*_row("unique", table, ", ".join(columns), F.col("_repeated")))


def check_relationship(
    child: DataFrame,
    table: str,
    columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
) -> DataFrame:
    """Number of child rows whose complete key has no parent row.

    Child rows are counted per key first, so a key shared by many rows is joined once.
    """
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    counted = child.where(complete).groupBy(*columns).agg(F.count("*").alias("_rows"))
    known = parent.select(
        *[F.col(p).alias(c) for c, p in zip(columns, parent_columns)]
    ).distinct()
    orphans = counted.join(known, list(columns), "left_anti").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("_orphans")
    )
    return orphans.select(*_row("relationship", table, ", ".join(columns), F.col("_orphans")))


def check_count(df: DataFrame, table: str, expected: int) -> DataFrame:
    """Distance of the row count from the expected one."""
    return df.agg(F.count("*").alias("_rows")).select(
        *_row("row_count", table, f"= {expected}", F.abs(F.col("_rows") - F.lit(expected)))
    )


def check_distinct_count(df: DataFrame, table: str, column: str, expected: int) -> DataFrame:
    return df.select(column).distinct().where(F.col(column).isNotNull()).agg(
        F.count("*").alias("_values")
    ).select(
        *_row("distinct_count", table, column, F.abs(F.col("_values") - F.lit(expected)))
    )


def check_not_empty(df: DataFrame, table: str) -> DataFrame:
    return df.limit(1).agg(F.count("*").alias("_rows")).select(
        *_row("not_empty", table, "*", 1 - F.col("_rows"))
    )


def check_row_parity(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference in row counts of two tables."""
    marked = a.select(F.lit(1).alias("_n")).unionByName(b.select(F.lit(-1).alias("_n")))
    return marked.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n")).select(
        *_row("row_parity", name, "*", F.abs("_n"))
    )


def check_copied(name: str, src: DataFrame, dst: DataFrame, on: Sequence[str]) -> DataFrame:
    """Number of source rows without an equal row in the copy; NULL equals NULL."""
    counted = src.groupBy(*on).agg(F.count("*").alias("_rows"))
    copy = dst.select(*on).distinct()
    lost = counted.join(copy, null_safe(counted, copy, on), "left_anti").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("_lost")
    )
    return lost.select(*_row("copied", name, ", ".join(on), F.col("_lost")))


def check_value_set(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Values missing from the column and values it should not have.

    ``expected`` has the same column. Rows: value, problem (``missing`` or ``unexpected``).
    """
    found = df.select(column).distinct().withColumn("_found", F.lit(True))
    wanted = expected.select(column).distinct().withColumn("_wanted", F.lit(True))
    joined = found.join(wanted, column, "full")
    return joined.where(F.col("_found").isNull() | F.col("_wanted").isNull()).select(
        F.col(column).cast("string").alias("value"),
        F.when(F.col("_found").isNull(), "missing").otherwise("unexpected").alias("problem"),
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    return union_all(
        [
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


@dataclass
class TableRules:
    """What a table has to satisfy."""

    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    unique_where: Mapping[str, tuple[Sequence[str], Column]] = field(default_factory=dict)
    accepted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    checks: Mapping[str, Column] = field(default_factory=dict)
    # columns -> (parent table, parent columns)
    relationships: Mapping[tuple[str, ...], tuple[str, tuple[str, ...]]] = field(
        default_factory=dict
    )
    row_count: int | None = None
    not_empty: bool = False
    # tables with as many rows
    parity: Sequence[str] = ()


def quality_report(
    tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules]
) -> DataFrame:
    """All checks of all tables, one row each: check, table, column, violations.

    Row tests and counts of a table share one scan; uniqueness and relationships take an
    aggregation each.
    """
    parts: list[DataFrame] = []
    for name, r in rules.items():
        df = tables[name]
        tests = {
            **not_null_tests(r.not_null),
            **accepted_tests(r.accepted),
            **rule_tests(r.checks),
        }
        totals = {}
        if r.row_count is not None:
            totals["row_count", f"= {r.row_count}"] = F.abs(F.count("*") - F.lit(r.row_count))
        if r.not_empty:
            totals["not_empty", "*"] = (F.count("*") == 0).cast("bigint")
        if tests or totals:
            parts.append(one_pass(df, name, tests, totals))
        parts += [check_unique(df, name, columns) for columns in r.unique]
        parts += [
            check_unique(df, name, columns, where).withColumn("column", F.lit(label))
            for label, (columns, where) in r.unique_where.items()
        ]
        parts += [
            check_relationship(df, name, columns, tables[parent], parent_columns)
            for columns, (parent, parent_columns) in r.relationships.items()
        ]
        parts += [check_row_parity(f"{name}, {other}", df, tables[other]) for other in r.parity]
    return union_all(parts)
