"""Data tests. Each row test returns the violating rows; an empty result passes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.contracts import Contract


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Values that occur more than once, with `n_rows`. Nulls never clash, as in a unique constraint.

    Counts are folded per map task before the shuffle, so a value in a third of the rows is no problem.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    rows = df.select(*columns)
    for column in columns:
        rows = rows.filter(F.col(column).isNotNull())
    return rows.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def accepted_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose value is outside the list; nulls are the business of `not_null`."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def unique_violations(silver: DataFrame, contract: Contract) -> DataFrame:
    """The contract's `unique` rules over a table: `column_name`, `value`, `n_rows`."""
    found = [
        unique(silver, name).select(
            F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"), "n_rows"
        )
        for name in contract.unique
    ]
    if not found:
        return silver.sparkSession.createDataFrame([], "column_name string, value string, n_rows bigint")
    result = found[0]
    for frame in found[1:]:
        result = result.unionByName(frame)
    return result


def row_count_gate(df: DataFrame, name: str, at_least: int = 1) -> DataFrame:
    """One row `name`, `n_rows`, `passed`: whether the table holds at least that many rows."""
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("name"), "n_rows", (F.col("n_rows") >= at_least).alias("passed")
    )


def ops_present(bronze: DataFrame, wanted: Sequence[str] = ("c", "r", "u")) -> DataFrame:
    """One row `present`: whether any of the wanted operations occurs."""
    return bronze.agg(F.coalesce(F.bool_or(F.col("_cdc_op").isin(*wanted)), F.lit(False)).alias("present"))


@dataclass(frozen=True)
class Check:
    """A declared test of one column: kind is not_null, unique or accepted_values."""

    kind: str
    column: str
    values: tuple[str, ...] = ()

    def violations(self, df: DataFrame) -> DataFrame:
        if self.kind == "not_null":
            return not_null(df, self.column)
        if self.kind == "unique":
            return unique(df, self.column)
        if self.kind == "accepted_values":
            return accepted_values(df, self.column, self.values)
        raise ValueError(f"unknown check {self.kind!r}")

    def row_condition(self) -> Column | None:
        """The violation as a row predicate; None for `unique`, which needs grouping."""
        column = F.col(self.column)
        if self.kind == "not_null":
            return column.isNull()
        if self.kind == "accepted_values":
            return column.isNotNull() & ~column.isin(*self.values)
        return None


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Violations per check: `check_name`, `column_name`, `n_violations`.

    All row checks share one pass over the table; each `unique` check adds one grouping.
    """
    parts = []
    row_checks = [c for c in checks if c.row_condition() is not None]
    if row_checks:
        counts = df.agg(*[F.count_if(c.row_condition()).alias(f"n{i}") for i, c in enumerate(row_checks)])
        entries = [
            F.struct(
                F.lit(c.kind).alias("check_name"),
                F.lit(c.column).alias("column_name"),
                F.col(f"n{i}").alias("n_violations"),
            )
            for i, c in enumerate(row_checks)
        ]
        parts.append(counts.select(F.inline(F.array(*entries))))
    for check in checks:
        if check.kind == "unique":
            parts.append(
                check.violations(df).agg(F.count("*").alias("n_violations")).select(
                    F.lit(check.kind).alias("check_name"), F.lit(check.column).alias("column_name"), "n_violations"
                )
            )
        elif check.row_condition() is None:
            raise ValueError(f"unknown check {check.kind!r}")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
