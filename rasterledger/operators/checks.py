"""Data-contract checks that fail with a bounded list of examples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def schema_contract(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row per expected column: (column, expected, found, holds, rows, missing_values).

    ``found`` is null for a column that is not there. One pass counts the values.
    """
    kinds = dict(df.dtypes)
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in expected if c in kinds))
    parts = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("expected"),
            F.lit(kinds.get(name)).cast("string").alias("found"),
            F.lit(kinds.get(name) == kind).alias("holds"),
            (F.col(f"_{name}") if name in kinds else F.col("rows")).alias("missing_values"),
        )
        for name, kind in expected.items()
    ]
    return counted.select("rows", F.inline(F.array(*parts))).select("column", "expected", "found", "holds", "rows", "missing_values")


def examples(df: DataFrame, column: str, limit: int = 20) -> list:
    """At most ``limit`` values for an error message, smallest first."""
    return [row[0] for row in df.select(column).orderBy(column).limit(limit).collect()]


def raise_if_any(violations: DataFrame, column: str, message: str, limit: int = 20) -> None:
    found = examples(violations, column, limit)
    if found:
        raise ValueError(f"{message}: {found}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str], message: str = "Duplicate keys") -> DataFrame:
    raise_if_any(duplicates(df, keys), keys[0], message)
    return df


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return [c for c in wanted if c in present]
