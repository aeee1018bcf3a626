"""Joins on time: versions valid at a date, half-open intervals, ledgers since a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(facts: DataFrame, versions: DataFrame, on: str, date: str, start: str = "effective_start",
                  end: str = "effective_end", how: str = "inner") -> DataFrame:
    """Facts with the version valid at their date: ``start <= date < end`` (a null end is open).

    Equality on the key plans a hash or sort-merge join; the range is its condition.
    """
    d = versions.withColumnRenamed(on, "_on")
    test = (facts[on] == d["_on"]) & (facts[date] >= d[start]) & (d[end].isNull() | (facts[date] < d[end]))
    return facts.join(d, test, how).drop("_on")


def point_in_time(facts: DataFrame, versions: DataFrame, fact_id: str, on: str, date: str,
                  start: str = "effective_start", end: str = "effective_end", rank: str = "version_rank") -> DataFrame:
    """Facts with one version each: the valid one, or the earliest for facts before any.

    A version qualifies when it has started or is the first one, and has not
    ended; started versions win, then the latest start.
    """
    d = versions.withColumnRenamed(on, "_on")
    test = (facts[on] == d["_on"]) & ((facts[date] >= d[start]) | (d[rank] == 1)) & (
        d[end].isNull() | (facts[date] < d[end]))
    joined = facts.join(d, test, "inner")
    order = [F.when(F.col(date) >= F.col(start), 0).otherwise(1), F.col(start).desc()]
    place = F.row_number().over(Window.partitionBy(fact_id).orderBy(*order))
    return joined.withColumn("_place", place).where("_place = 1").drop("_place", "_on")


def ledger_since(snapshots: DataFrame, changes: DataFrame, key: Sequence[str], amount: str, at: str,
                 snapshot_at: str, total: str = "change_total", last: str = "last_change_at") -> DataFrame:
    """Every snapshot with the sum of its key's changes at or after it; no changes give zero."""
    s = snapshots.select(*key, F.col(snapshot_at).alias("_since"))
    moved = changes.join(s, list(key)).where(F.col(at) >= F.col("_since")).groupBy(*key).agg(
        F.sum(amount).alias(total), F.max(at).alias(last))
    return snapshots.join(moved, list(key), "left").withColumn(total, F.coalesce(total, F.lit(0)))


def lagged_change(column: str, key: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.col(column) - F.lag(column).over(Window.partitionBy(*key).orderBy(*order))
