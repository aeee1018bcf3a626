"""Shipments: text to typed rows, reasons, the star join and the monthly summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.clean import currency, date_of, mapped, number, trimmed
from quarrystone.operators.classify import classify, known
from quarrystone.operators.dedupe import exact, with_conflict

# Date layouts and status names of the raw files.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yy")
STATUSES = {"cancelled": "cancelled", "delivered": "delivered", "in transit": "in_transit", "pending": "pending"}


def clean_shipments(raw: DataFrame) -> DataFrame:
    """Typed columns beside the raw text, which is kept."""
    t = trimmed(raw).withColumn("_date_text", F.concat_ws(
        "-", F.split_part("SHIP_DATE", F.lit("-"), F.lit(1)),
        F.initcap(F.split_part("SHIP_DATE", F.lit("-"), F.lit(2))), F.split_part("SHIP_DATE", F.lit("-"), F.lit(3))))
    text = F.when(F.col("SHIP_DATE").rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"), F.col("_date_text")).otherwise(F.col("SHIP_DATE"))
    return t.select(
        F.col("SHIPMENT_ID").alias("shipment_id"), F.col("WAREHOUSE_ID").alias("warehouse_id"),
        F.col("PROGRAMME_ID").alias("programme_id"), F.col("ITEM_CODE").alias("item_code"),
        F.col("QUANTITY").alias("quantity_raw"), number("QUANTITY", "int").alias("quantity"),
        F.col("SHIP_DATE").alias("ship_date_raw"), date_of(text, DATE_FORMATS).alias("ship_date"),
        F.col("STATUS").alias("status_raw"), mapped("STATUS", STATUSES).alias("status"),
        F.col("UNIT_COST").alias("unit_cost_raw"), currency("UNIT_COST").alias("unit_cost"))


def classify_shipments(clean: DataFrame, warehouses: DataFrame, programmes: DataFrame, items: DataFrame,
                       strict_status: bool = False):
    """``(accepted, quarantined)`` after exact copies went (cost included).

    Unmatched and null keys are both ``missing``.  Text in a quantity that is
    no number is ``invalid_quantity``; ``strict_status`` also sets aside
    statuses that are not known.
    """
    df = with_conflict(exact(clean), ["shipment_id"])
    for column, dim, key in (("warehouse_id", warehouses, "WAREHOUSE_ID"), ("programme_id", programmes, "PROGRAMME_ID"),
                             ("item_code", items, "ITEM_CODE")):
        df = known(df, column, dim, key, f"_{column}")
    blank = F.col("quantity_raw").isNull() | (F.trim("quantity_raw") == "")
    rules = [
        ("conflicting_duplicate", F.col("is_conflicting")), ("missing_warehouse", ~F.col("_warehouse_id")),
        ("missing_programme", ~F.col("_programme_id")), ("missing_item", ~F.col("_item_code")),
        ("missing_quantity", blank), ("invalid_quantity", ~blank & F.col("quantity").isNull()),
        ("non_positive_quantity", F.col("quantity") <= 0), ("invalid_ship_date", F.col("ship_date").isNull())]
    if strict_status:
        rules.append(("invalid_status", F.col("status").isNull()))
    helpers = ["_warehouse_id", "_programme_id", "_item_code", "is_conflicting"]
    accepted, rejected = classify(df, rules)
    return accepted.drop(*helpers), rejected.drop(*helpers)


def fact_shipments(accepted: DataFrame, warehouses: DataFrame, programmes: DataFrame, items: DataFrame) -> DataFrame:
    return (accepted.join(warehouses, "warehouse_id").join(programmes, "programme_id").join(items, "item_code")
            .withColumn("total_cost", F.col("quantity") * F.col("unit_cost")))


def monthly_summary(fact: DataFrame) -> DataFrame:
    return fact.where("status <> 'cancelled'").groupBy(
        "programme_id", F.date_format("ship_date", "yyyy-MM").alias("ship_month")).agg(
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        F.sum("total_cost").cast("decimal(18,2)").cast("double").alias("total_cost"),
        F.count(F.lit(1)).alias("n_shipments"))
