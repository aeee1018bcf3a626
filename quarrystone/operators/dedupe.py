"""Duplicate handling: latest row, exact copies, conflicting copies, precedence, checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; give a unique tie-break to make it certain."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def exact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns) if columns else None)


def with_conflict(df: DataFrame, key: Sequence[str], flag: str = "is_conflicting") -> DataFrame:
    """Marks every row of a key that still has several rows (after exact copies went)."""
    return df.withColumn(flag, F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1)


def split_conflicts(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(clean, conflicting)``; the whole group of a conflicting key is set aside."""
    marked = with_conflict(df, key)
    return marked.where("NOT is_conflicting").drop("is_conflicting"), marked.where("is_conflicting").drop("is_conflicting")


def by_precedence(batches: Sequence[DataFrame], key: Sequence[str], tie: Sequence[Column] = ()) -> DataFrame:
    """One row for each key from the first batch that has it."""
    union = None
    for rank, df in enumerate(batches):
        ranked = df.withColumn("_rank", F.lit(rank))
        union = ranked if union is None else union.unionByName(ranked, allowMissingColumns=True)
    return latest(union, key, [F.col("_rank"), *tie]).drop("_rank")


def canonical(df: DataFrame, checksum: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """``(canonical rows, duplicates)`` by content checksum; duplicates name what they repeat."""
    by = Window.partitionBy(checksum).orderBy(*order)
    ranked = df.withColumn("_place", F.row_number().over(by))
    return ranked.where("_place = 1").drop("_place"), ranked.where("_place > 1").drop("_place")


def deterministic_sample(df: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """The ``n`` rows (1 to 20) with the smallest fingerprints of the allowed columns."""
    if not 1 <= n <= 20:
        raise ValueError("a sample has 1 to 20 rows")
    picked = df.select(*columns)
    return picked.orderBy(F.sha2(F.to_json(F.struct(*columns)), 256)).limit(n)
