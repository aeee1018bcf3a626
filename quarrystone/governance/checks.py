"""Data tests: each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(" OR ".join(f"`{c}` IS NULL" for c in columns))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def expression(df: DataFrame, test: str) -> DataFrame:
    return df.where(f"NOT coalesce({test}, false)")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(
        F.count(F.lit(1)).alias("n_rows"))


def key_audit(df: DataFrame, *key: str) -> DataFrame:
    """One row: rows, null keys and keys that repeat, in one pass over groups."""
    some_null = " OR ".join(f"`{k}` IS NULL" for k in key)
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
                      F.coalesce(F.sum(F.expr(f"CASE WHEN {some_null} THEN n ELSE 0 END")), F.lit(0)).cast("bigint").alias("null_keys"),
                      F.count_if(F.expr(f"n > 1 AND NOT ({some_null})")).alias("duplicate_keys"))


def totals_agree(left: DataFrame, right: DataFrame, key: str, left_total: str, right_total: str,
                 tolerance: float = 0.01) -> DataFrame:
    """Keys whose totals differ by more than the tolerance, or that one side lacks."""
    a = left.groupBy(key).agg(F.sum(left_total).alias("left_total"))
    b = right.groupBy(key).agg(F.sum(right_total).alias("right_total"))
    return a.join(b, key, "full_outer").where(
        f"left_total IS NULL OR right_total IS NULL OR abs(left_total - right_total) > {tolerance}")
