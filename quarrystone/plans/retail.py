"""Franchise sales: enriched transactions, revenue aggregates, ranks and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.clean import average, exact, money, spend_tier


EXPECT_OR_DROP = {"valid_id": "transactionID IS NOT NULL", "valid_total": "totalPrice > 0", "valid_quantity": "quantity > 0"}
EXPECT = {"valid_unit_price": "unitPrice > 0"}


def expected(df: DataFrame, drop: dict[str, str] = EXPECT_OR_DROP) -> DataFrame:
    """Rows that meet every dropping expectation (an unknown result drops the row)."""
    for rule in drop.values():
        df = df.where(rule)
    return df


def expectation_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row: how many rows break each rule, in one pass."""
    return df.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()])


def enriched(transactions: DataFrame, franchises: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions with their franchise and customer (left, so orphans stay) and date parts."""
    f = franchises.select("franchiseID", "franchise_name", "city", "district", "country", F.col("size").alias("store_size"),
                          "longitude", "latitude")
    c = customers.select("customerID", "customer_name", "gender", F.col("country").alias("customer_country"),
                         F.col("continent").alias("customer_continent"))
    return (expected(transactions).join(f, "franchiseID", "left").join(c, "customerID", "left")
            .withColumns({"transaction_date": F.to_date("dateTime"), "transaction_hour": F.hour("dateTime"),
                          "transaction_month": F.date_format("dateTime", "yyyy-MM")}))


def supplier_details(franchises: DataFrame, suppliers: DataFrame) -> DataFrame:
    s = suppliers.select("supplierID", F.col("name").alias("supplier_name"), "ingredient", "approved")
    return franchises.join(s, "supplierID", "left").select(
        "franchiseID", "franchise_name", "country", "supplierID", "supplier_name", "ingredient", "approved")


DAILY = ("transaction_date", "transaction_month", "franchiseID", "franchise_name", "city", "country", "store_size", "product")
STORE = ("franchiseID", "franchise_name", "city", "district", "country", "store_size", "longitude", "latitude")
CUSTOMER = ("customerID", "customer_name", "gender", "customer_country", "customer_continent")


def revenue() -> Column:
    return money(F.sum("totalPrice"))


def units() -> Column:
    return F.sum("quantity").cast("bigint")


def daily_revenue(sales: DataFrame) -> DataFrame:
    """Revenue, units, transactions and average ticket by day, franchise and product."""
    return sales.groupBy(*DAILY).agg(
        revenue().alias("total_revenue"), units().alias("total_units_sold"), F.count("transactionID").alias("transaction_count"),
        average("totalPrice").alias("avg_transaction_value"))


def revenue_by(daily: DataFrame, *keys: str) -> DataFrame:
    """Daily revenue summed up by any of its keys."""
    return daily.groupBy(*keys).agg(
        money(F.sum(exact("total_revenue"))).alias("daily_revenue"), F.sum("total_units_sold").alias("daily_units"),
        F.sum("transaction_count").alias("daily_transactions"))


def product_performance(sales: DataFrame) -> DataFrame:
    """By product, with the share of all revenue; the total is one row joined on, not a one-partition window."""
    by = sales.groupBy("product").agg(
        F.sum("totalPrice").alias("revenue"), units().alias("total_units_sold"), F.count("transactionID").alias("transaction_count"),
        average("unitPrice").alias("avg_unit_price"), average("totalPrice").alias("avg_transaction_value"),
        F.count_distinct("customerID").alias("unique_customers"))
    whole = by.agg(F.sum("revenue").alias("all_revenue"))
    share = F.round(F.col("revenue").cast("double") / F.col("all_revenue").cast("double"), 4)
    return by.crossJoin(F.broadcast(whole)).select(
        "product", money("revenue").alias("total_revenue"), "total_units_sold", "transaction_count", "avg_unit_price",
        "avg_transaction_value", "unique_customers", share.alias("revenue_share"))


def franchise_ranking(sales: DataFrame) -> DataFrame:
    by = sales.groupBy(*STORE).agg(
        F.sum("totalPrice").alias("revenue"), units().alias("total_units_sold"), F.count("transactionID").alias("transaction_count"),
        average("totalPrice").alias("avg_basket_size"), F.count_distinct("customerID").alias("unique_customers"))
    place = F.rank().over(Window.orderBy(F.col("revenue").desc()))  # one row per franchise by now
    return by.withColumn("revenue_rank", place.cast("bigint")).withColumn("total_revenue", money("revenue")).drop("revenue")


def stores_by(ranking: DataFrame, key: str, count: str) -> DataFrame:
    """Franchises of a country or size: how many, what they sold, and the average of their average baskets."""
    return ranking.groupBy(key).agg(
        F.count_distinct("franchiseID").alias(count), money(F.sum(exact("total_revenue"))).alias("total_revenue"),
        F.sum("transaction_count").alias("total_transactions"), average(exact("avg_basket_size")).alias("avg_basket_size"))


def customer_segments(sales: DataFrame) -> DataFrame:
    spend = sales.groupBy("customerID", "product").agg(F.sum("totalPrice").alias("spent"))
    place = F.row_number().over(Window.partitionBy("customerID").orderBy(F.col("spent").desc(), F.col("product")))
    favourite = spend.withColumn("_n", place).where("_n = 1").select(
        "customerID", F.col("product").alias("favourite_product"))
    by = sales.groupBy(*CUSTOMER).agg(
        F.sum("totalPrice").alias("spent"), F.count("transactionID").alias("visit_count"),
        average("totalPrice").alias("avg_spend_per_visit"), F.count_distinct("franchiseID").alias("stores_visited"),
        F.count_distinct("transaction_date").alias("active_days"))
    return by.join(favourite, "customerID", "left").select(
        *CUSTOMER, money("spent").alias("total_spend"), "visit_count", "avg_spend_per_visit", "stores_visited", "active_days",
        spend_tier(F.col("spent")).alias("spend_tier"), "favourite_product")


def tier_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("spend_tier").agg(
        F.count("customerID").alias("customer_count"), average(exact("total_spend")).alias("avg_spend"),
        average("visit_count", 1).alias("avg_visits"), average("active_days", 1).alias("avg_active_days"),
        average("stores_visited", 1).alias("avg_stores_visited"))


def favourites(segments: DataFrame) -> DataFrame:
    return segments.groupBy("gender", "favourite_product").agg(
        F.count(F.lit(1)).alias("customer_count"), average(exact("total_spend")).alias("avg_spend"))


def kpis(sales: DataFrame) -> DataFrame:
    """One row; a transaction that has several rows counts once."""
    return sales.agg(
        F.count_distinct("transactionID").alias("total_transactions"), F.count_distinct("customerID").alias("unique_customers"),
        F.count_distinct("franchiseID").alias("active_franchises"), revenue().alias("total_revenue"),
        average("totalPrice").alias("avg_basket_size"),
        F.round(F.sum("totalPrice").cast("double") / F.count_distinct("transaction_date"), 2).alias("avg_daily_revenue"))


def hourly(sales: DataFrame) -> DataFrame:
    return sales.groupBy("transaction_hour").agg(
        F.count("transactionID").alias("transaction_count"), revenue().alias("total_revenue"),
        average("totalPrice").alias("avg_basket_size"))


def payment_mix(sales: DataFrame) -> DataFrame:
    by = sales.groupBy("paymentMethod").agg(
        F.count("transactionID").alias("transaction_count"), revenue().alias("total_revenue"),
        average("totalPrice").alias("avg_basket_size"), F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a few rows by now
    return by.withColumn("pct_of_transactions", F.round(F.col("n") * 100.0 / total, 2)).drop("n")


def top_n(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(n)
