"""Slowly changing dimensions: versions from snapshots, and incremental versions without MERGE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import surrogate_key

OPEN_END = "9999-12-31"


def versions_from_snapshots(snapshots: DataFrame, key: str, snapshot_date: str, tracked: Sequence[str]) -> DataFrame:
    """Versions of a key over any number of full snapshots in one table.

    A row opens a version when a tracked value differs from the key's snapshot
    before (nulls compare equal).  Adds ``effective_start``, ``effective_end``
    (null while current), ``version_rank`` and ``is_current``.  A key missing
    from a later snapshot stays current.
    """
    by = Window.partitionBy(key).orderBy(snapshot_date)
    state = F.struct(*tracked)
    before = F.lag(state).over(by)
    first = F.row_number().over(by) == 1
    changed = snapshots.withColumn("_opens", first | ~before.eqNullSafe(state)).where("_opens").drop("_opens")
    return (changed.withColumn("effective_start", F.col(snapshot_date))
            .withColumn("effective_end", F.lead(snapshot_date).over(by))
            .withColumn("version_rank", F.row_number().over(by))
            .withColumn("is_current", F.col("effective_end").isNull()))


def apply_snapshot(current: DataFrame, snapshot: DataFrame, key: str, tracked: Sequence[str], date: str,
                   check_order: bool = True) -> DataFrame:
    """A dimension after one more snapshot: new and changed keys open, changed and absent ones end.

    ``current`` has the key, the tracked columns, ``attr_hash``, ``sk``,
    ``effective_start``, ``effective_end`` and ``is_current``; dates are ISO
    texts' dates.  A snapshot older than the newest version is refused, and one
    of the same date changes nothing again, so replays are harmless.
    """
    at = F.lit(date).cast("date")
    if check_order:
        newest = current.agg(F.max("effective_start")).first()[0]
        if newest is not None and str(newest) > date:
            raise ValueError(f"snapshot {date} is older than {newest}")
    columns = [key, *tracked, "attr_hash", "sk", "effective_start", "effective_end", "is_current"]
    inc = snapshot.select(key, *tracked).dropDuplicates([key]).withColumn("attr_hash", surrogate_key(*tracked)).alias("i")
    live = current.where("is_current").select(key, F.col("attr_hash").alias("old_hash")).alias("c")
    diff = inc.join(live, key, "full_outer")
    opened = diff.where("attr_hash IS NOT NULL AND (old_hash IS NULL OR old_hash <> attr_hash)").select(
        key, *tracked, "attr_hash", surrogate_key(F.col(key), F.lit(date)).alias("sk"), at.alias("effective_start"),
        F.lit(OPEN_END).cast("date").alias("effective_end"), F.lit(True).alias("is_current"))
    ended = diff.where("old_hash IS NOT NULL AND (attr_hash IS NULL OR old_hash <> attr_hash)").select(
        F.col(key).alias("_key"), F.lit(True).alias("_ends"))
    kept = current.join(ended, current[key] == ended["_key"], "left")
    stops = F.col("is_current") & F.col("_ends").eqNullSafe(True)
    kept = kept.withColumn("effective_end", F.when(stops, at).otherwise(F.col("effective_end"))).withColumn(
        "is_current", F.col("is_current") & ~stops)
    return kept.select(*columns).unionByName(opened.select(*columns))


def empty_dimension(snapshot: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """A dimension without versions, with the layout that ``apply_snapshot`` keeps."""
    return snapshot.limit(0).select(
        key, *tracked, F.lit("").alias("attr_hash"), F.lit("").alias("sk"),
        F.lit(None).cast("date").alias("effective_start"), F.lit(None).cast("date").alias("effective_end"),
        F.lit(True).alias("is_current"))
