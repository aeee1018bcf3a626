"""Reason-coded classification of rows into accepted and quarantined."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = "quarantine_reasons"


def with_reasons(df: DataFrame, rules: Iterable[tuple[str, Column]], name: str = REASONS) -> DataFrame:
    """All reasons that hold for a row, in the order of the rules; a null condition does not hold."""
    codes = F.array(*[F.when(test, F.lit(code)) for code, test in rules])
    return df.withColumn(name, F.filter(codes, lambda c: c.isNotNull()))


def classify(df: DataFrame, rules: Iterable[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantined)``; both are projections of one plan, so persist ``df`` if both are written."""
    marked = with_reasons(df, rules)
    return marked.where(F.size(REASONS) == 0).drop(REASONS), marked.where(F.size(REASONS) > 0)


def joined_reasons(separator: str = "; ", name: str = REASONS) -> Column:
    return F.array_join(F.col(name), separator)


def comments(texts: Mapping[str, str], name: str = REASONS) -> Column:
    """One sentence for each reason, joined by a space."""
    lookup = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return F.array_join(F.transform(F.col(name), lambda c: F.coalesce(lookup[c], c)), " ")


def reason_counts(quarantined: DataFrame, name: str = REASONS) -> DataFrame:
    return quarantined.select(F.explode(name).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_rows"))


def known(df: DataFrame, column: str, dimension: DataFrame, key: str, flag: str) -> DataFrame:
    """A flag whether the foreign key has a row in the dimension (false for null).

    The dimension is reduced to its distinct keys, so rows never fan out; the
    optimiser broadcasts them when they are small.
    """
    keys = dimension.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct().withColumn(flag, F.lit(True))
    return df.join(keys, df[column] == keys["_key"], "left").drop("_key").withColumn(
        flag, F.coalesce(flag, F.lit(False)))


def reconcile(**counts: DataFrame) -> DataFrame:
    """One row: rows of each named frame; ``balanced`` if source = accepted + quarantined + excluded."""
    parts = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias(f"{name}_rows"))
        parts = one if parts is None else parts.crossJoin(one)
    have = [F.col(f"{n}_rows") for n in ("accepted", "quarantined", "excluded") if n in counts]
    total = have[0]
    for c in have[1:]:
        total = total + c
    return parts.withColumn("balanced", F.col("source_rows") == total)
