"""Stock ledger: exploded changes, reason codes, snapshots, current stock and its reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.clean import optional
from quarrystone.operators.classify import REASONS, classify, known
from quarrystone.operators.dedupe import latest
from quarrystone.operators.temporal import ledger_since

ONLINE_STORE = 99


def explode_changes(events: DataFrame) -> DataFrame:
    """One row for each item of each event."""
    return events.select(
        "trans_id", "store_id", F.try_to_timestamp(F.col("date_time").cast("string")).alias("date_time"),
        "change_type_id", "bopis_order_id", optional(events, "channel").alias("channel"),
        F.explode("items").alias("item")).select("*", F.col("item.item_id"), F.col("item.quantity")).drop("item")


def classify_changes(changes: DataFrame, stores: DataFrame, items: DataFrame, kinds: DataFrame):
    """``(accepted, quarantined)``; accepted changes are the latest of each transaction and item.

    A null key is ``missing``; only a key that isn't null and has no row is
    ``unknown``.  A change type asks for a sign; zero passes either.
    """
    df = known(changes, "store_id", stores, "store_id", "_store")
    df = known(df, "item_id", items, "item_id", "_item")
    signs = kinds.select(F.col("change_type_id").alias("_kind"), "change_type", F.when(
        F.col("expected_sign") == "positive", 1).otherwise(-1).alias("_sign")).dropDuplicates(["_kind"])
    df = df.join(signs, df["change_type_id"] == signs["_kind"], "left")
    accepted, rejected = classify(df, [
        ("missing_trans_id", F.col("trans_id").isNull() | (F.col("trans_id") == "")),
        ("missing_store_id", F.col("store_id").isNull()),
        ("missing_date_time", F.col("date_time").isNull()),
        ("missing_item_id", F.col("item_id").isNull()),
        ("missing_quantity", F.col("quantity").isNull()),
        ("unknown_store_id", F.col("store_id").isNotNull() & ~F.col("_store")),
        ("unknown_item_id", F.col("item_id").isNotNull() & ~F.col("_item")),
        ("unknown_change_type_id", F.col("change_type_id").isNotNull() & F.col("_kind").isNull()),
        ("invalid_quantity_sign", F.col("quantity") * F.col("_sign") < 0),
    ])
    helpers = ["_store", "_item", "_kind", "_sign"]
    tie = F.sha2(F.to_json(F.struct("store_id", "quantity", "change_type_id", "bopis_order_id", "channel")), 256)
    newest = latest(accepted.drop(*helpers), ["trans_id", "item_id"], [F.col("date_time").desc(), tie])
    return newest, rejected.drop(*helpers)


def classify_snapshots(snapshots: DataFrame, stores: DataFrame, items: DataFrame):
    df = snapshots.withColumn("date_time", F.try_to_timestamp(F.col("date_time").cast("string")))
    df = known(known(df, "store_id", stores, "store_id", "_store"), "item_id", items, "item_id", "_item")
    accepted, rejected = classify(df, [
        ("missing_id", F.col("id").isNull()), ("missing_item_id", F.col("item_id").isNull()),
        ("missing_store_id", F.col("store_id").isNull()), ("missing_date_time", F.col("date_time").isNull()),
        ("missing_quantity", F.col("quantity").isNull()),
        ("unknown_store_id", F.col("store_id").isNotNull() & ~F.col("_store")),
        ("unknown_item_id", F.col("item_id").isNotNull() & ~F.col("_item")),
        ("negative_snapshot_quantity", F.col("quantity") < 0),
    ])
    return accepted.drop("_store", "_item"), rejected.drop("_store", "_item")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return latest(snapshots, ["store_id", "item_id"], [F.col("date_time").desc(), F.col("id").desc()])


def current_stock(snapshots: DataFrame, changes: DataFrame, items: DataFrame) -> DataFrame:
    """Stock now: the latest snapshot plus the changes since, with the safety flag.

    A paired online order is taken from stock where it is picked up, so its
    online leg does not count.
    """
    counted = changes.where(~((F.col("store_id") == ONLINE_STORE) & F.col("bopis_order_id").isNotNull()))
    ledger = ledger_since(latest_snapshots(snapshots), counted, ["store_id", "item_id"], "quantity", "date_time", "date_time")
    current = F.col("quantity") + F.col("change_total")
    return ledger.join(items.select("item_id", "item_name", "category", "safety_stock_quantity"), "item_id", "left").select(
        "store_id", "item_id", "item_name", "category", F.col("quantity").alias("snapshot_quantity"),
        F.col("change_total").cast("bigint").alias("change_quantity"), current.cast("bigint").alias("current_quantity"),
        "safety_stock_quantity", (current < F.col("safety_stock_quantity")).alias("below_safety_stock"),
        F.col("date_time").alias("snapshot_at"), F.greatest("date_time", "last_change_at").alias("last_movement_at"))


def stock_kpis(stock: DataFrame) -> DataFrame:
    return stock.agg(F.count(F.lit(1)).alias("n_positions"), F.sum("current_quantity").cast("bigint").alias("units"),
                     F.count_if("below_safety_stock").alias("below_safety"),
                     F.count_distinct("store_id").alias("n_stores"))


def stock_by(stock: DataFrame, key: str) -> DataFrame:
    return stock.groupBy(key).agg(F.sum("current_quantity").cast("bigint").alias("units"),
                                  F.count_if("below_safety_stock").alias("below_safety"),
                                  F.count(F.lit(1)).alias("n_positions"))


def sales_of(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change_type").isin("sale", "bopis")).withColumn("units_sold", F.abs("quantity"))


def sales_by(changes: DataFrame, *keys: str) -> DataFrame:
    return sales_of(changes).groupBy(*keys).agg(F.sum("units_sold").cast("bigint").alias("units_sold"),
                                                F.count_distinct("trans_id").alias("n_transactions"))


def quality_trend(profiles: DataFrame) -> DataFrame:
    """Rejections of the silver layer, a row for each run."""
    return profiles.where("layer = 'silver'").select("run_id", "profiled_at", "rejected_records", "rejected_rate")


def failed_rules(quarantines: Sequence[DataFrame], n: int = 10) -> DataFrame:
    """The rules that set most rows aside over several quarantines."""
    reasons = reduce(DataFrame.unionByName, [q.select(F.explode(REASONS).alias("quality_rule")) for q in quarantines])
    return reasons.groupBy("quality_rule").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "quality_rule").limit(n)


SERVED = ("store_id", "store_name", "store_type", "item_id", "item_name", "category", "snapshot_quantity", "snapshot_date_time",
          "inventory_change_quantity", "current_inventory_quantity", "safety_stock_quantity", "below_safety_stock",
          "last_inventory_timestamp")


def served_stock(stock: DataFrame, stores: DataFrame) -> DataFrame:
    """The published layout, with what is short and least in stock first."""
    named = stock.join(stores.select("store_id", "store_name", "store_type"), "store_id", "left").withColumnsRenamed({
        "snapshot_at": "snapshot_date_time", "change_quantity": "inventory_change_quantity",
        "current_quantity": "current_inventory_quantity", "last_movement_at": "last_inventory_timestamp"})
    return named.select(*SERVED).orderBy(F.desc("below_safety_stock"), "current_inventory_quantity", "store_id", "item_id")


def freshness_minutes(df: DataFrame, at: str, now) -> DataFrame:
    return df.agg(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.max(at).cast("timestamp"))) / 60).alias("minutes"))
