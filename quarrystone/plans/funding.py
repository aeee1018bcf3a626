"""Contributions: two layouts in one, exchange rates, reasons, versions and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.clean import date_of, fiscal_year, number, renamed
from quarrystone.operators.classify import classify, comments, known
from quarrystone.operators.dedupe import by_precedence, exact, split_conflicts
from quarrystone.operators.temporal import point_in_time

DATE_FORMATS = ("MM/dd/yyyy", "dd-MMM-yy", "yyyy-MM-dd")  # fixed values, in this order; then milliseconds since 1970
LAYOUT = ("contribution_id", "donor_id", "programme_id", "fiscal_year", "contribution_date", "currency_original",
          "amount_original", "exchange_rate_to_usd", "amount_usd", "status", "grant_id", "payment_method", "notes")
COMMENTS = {
    "missing_donor": "The donor is not in the donor list.",
    "missing_programme": "The programme is not in the programme list.",
    "missing_amount": "There is no amount.",
    "non_positive_amount": "The amount is not above zero.",
    "invalid_date": "The date can't be read.",
    "missing_exchange_rate": "There is no exchange rate for the currency and month.",
    "conflicting_duplicate": "Rows of one contribution disagree.",
}


def normalised(raw: DataFrame, batch: str) -> DataFrame:
    """Either layout (upper-case csv, lower-case json) as typed columns; absent ones are null."""
    df = renamed(raw, {n: (n, "string") for n in LAYOUT})
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.select(
        text("contribution_id").alias("contribution_id"), text("donor_id").alias("donor_id"),
        text("programme_id").alias("programme_id"), F.trim("fiscal_year").alias("fiscal_year_raw"),
        fiscal_year("fiscal_year").alias("fiscal_year"),
        date_of("contribution_date", DATE_FORMATS, epoch_millis=True).alias("contribution_date"),
        F.upper(text("currency_original")).alias("currency_original"),
        number("amount_original", "decimal(18,2)").alias("amount_original"),
        number("exchange_rate_to_usd", "decimal(18,8)").alias("exchange_rate_to_usd"),
        number("amount_usd", "decimal(18,2)").alias("source_amount_usd"),
        F.lower(F.trim("status")).alias("status"), F.trim("grant_id").alias("grant_id"),
        F.trim("payment_method").alias("payment_method"), F.trim("notes").alias("notes"), F.lit(batch).alias("source_batch"))


def with_rates(df: DataFrame, rates: DataFrame) -> DataFrame:
    """The dollar amount: the source's, else the original at the month's listed rate."""
    r = rates.select(F.upper(F.trim("currency")).alias("_currency"), F.col("rate_month").alias("_month"),
                     F.col("rate_to_usd").cast("decimal(18,8)").alias("_rate")).dropDuplicates(["_currency", "_month"])
    joined = df.join(r, (df["currency_original"] == r["_currency"])
                     & (F.date_format(df["contribution_date"], "yyyy-MM") == r["_month"]), "left")
    rate = F.coalesce("exchange_rate_to_usd", "_rate")
    usd = F.coalesce("source_amount_usd", (F.col("amount_original") * F.col("_rate")).cast("decimal(18,2)"))
    return joined.withColumn("applied_rate", rate).withColumn("amount_usd", usd).withColumnRenamed("_rate", "listed_rate").drop(
        "_currency", "_month")


def classify_contributions(csv: DataFrame, json: DataFrame, rates: DataFrame, donors: DataFrame, programmes: DataFrame):
    """``(accepted, quarantined)``.  Conflicts inside a batch set the whole id aside, in both batches, for that reason alone."""
    csv_clean, csv_conflict = split_conflicts(exact(csv), ["contribution_id"])
    json_clean, json_conflict = split_conflicts(exact(json), ["contribution_id"])
    bad = csv_conflict.unionByName(json_conflict).select("contribution_id").distinct()
    merged = by_precedence([json_clean.join(bad, "contribution_id", "left_anti"),
                            csv_clean.join(bad, "contribution_id", "left_anti")], ["contribution_id"])
    aside = csv_clean.unionByName(json_clean).join(bad, "contribution_id", "left_semi").unionByName(
        csv_conflict).unionByName(json_conflict)
    df = with_rates(merged.withColumn("_conflict", F.lit(False)).unionByName(aside.withColumn("_conflict", F.lit(True))), rates)
    df = known(known(df, "donor_id", donors, "donor_id", "_donor"), "programme_id", programmes, "programme_id", "_programme")
    alone = {
        "missing_donor": ~F.col("_donor"), "missing_programme": ~F.col("_programme"),
        "missing_amount": F.col("amount_original").isNull(), "non_positive_amount": F.col("amount_original") <= 0,
        "invalid_date": F.col("contribution_date").isNull(),
        "missing_exchange_rate": (F.col("source_batch") == "json") & F.col("amount_original").isNotNull()
        & F.col("contribution_date").isNotNull() & F.col("listed_rate").isNull(),
    }
    accepted, rejected = classify(df, [*((name, ~F.col("_conflict") & test) for name, test in alone.items()),
                                       ("conflicting_duplicate", F.col("_conflict"))])
    helpers = ["_conflict", "_donor", "_programme", "listed_rate"]
    return accepted.drop(*helpers), rejected.drop(*helpers).withColumn("comment", comments(COMMENTS))


def conform_donors(raw: DataFrame) -> DataFrame:
    """The donor list: trimmed, with lower-case types, one row for each id."""
    df = renamed(raw, {n: (n, "string") for n in ("donor_id", "donor_name", "donor_type", "country")})
    return df.select(F.trim("donor_id").alias("donor_id"), F.trim("donor_name").alias("donor_name"),
                     F.lower(F.trim("donor_type")).alias("donor_type"), F.trim("country").alias("country")).dropDuplicates(["donor_id"])


def conform_rates(raw: DataFrame) -> DataFrame:
    """Exchange rates, one row for each currency and month."""
    df = renamed(raw, {n: (n, "string") for n in ("currency", "rate_month", "rate_to_usd")})
    return df.select(F.upper(F.trim("currency")).alias("currency"), F.trim("rate_month").alias("rate_month"),
                     number("rate_to_usd", "decimal(18,8)").alias("rate_to_usd")).dropDuplicates(["currency", "rate_month"])


def grants(raw: DataFrame) -> DataFrame:
    """Nested grants as columns: reporting frequency, next due date from milliseconds, tags joined by commas."""
    none = F.array().cast("array<string>")
    tags = F.coalesce(F.col("tags").cast("array<string>"), none) if "tags" in raw.columns else none
    return raw.select(
        *(F.trim(c).alias(c) for c in ("grant_id", "grant_reference", "donor_id", "programme_id")),
        F.col("amount_committed_usd").try_cast("decimal(18,2)").alias("amount_committed_usd"),
        date_of("signed_date", ("yyyy-MM-dd",)).alias("signed_date"),
        F.col("reporting.frequency").cast("string").alias("reporting_frequency"),
        date_of("reporting.next_due_date_epoch", (), epoch_millis=True).alias("next_due_date"),
        F.concat_ws(",", tags).alias("tags_str")).dropDuplicates(["grant_id"])


def fact_contributions(accepted: DataFrame, versions: DataFrame) -> DataFrame:
    return point_in_time(accepted, versions, "contribution_id", "programme_id", "contribution_date")


def funding_summary(contributions: DataFrame) -> DataFrame:
    amount = lambda s: F.sum(F.when(F.col("status") == s, F.col("amount_usd")).otherwise(F.lit(0)))
    return contributions.groupBy("programme_id", "fiscal_year").agg(
        amount("committed").cast("decimal(18,2)").alias("committed_usd"),
        amount("received").cast("decimal(18,2)").alias("received_usd"), F.count(F.lit(1)).alias("n_contributions"))


def legacy_variance(new: DataFrame, legacy: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Both summaries side by side by programme and year; a side that lacks a key counts as zero."""
    a = new.select("programme_id", "fiscal_year", F.col("committed_usd").alias("new_committed"), F.col("received_usd").alias("new_received"))
    b = legacy.select("programme_id", "fiscal_year", F.col("committed_usd").alias("old_committed"), F.col("received_usd").alias("old_received"))
    zero = F.lit(0).cast("decimal(18,2)")
    both = a.join(b, ["programme_id", "fiscal_year"], "full_outer")
    diff = lambda x: F.coalesce(f"new_{x}", zero) - F.coalesce(f"old_{x}", zero)
    return both.select("programme_id", "fiscal_year", diff("committed").cast("double").alias("committed_diff"),
                       diff("received").cast("double").alias("received_diff"),
                       ((F.abs(diff("committed")) > tolerance) | (F.abs(diff("received")) > tolerance)).alias("is_variance"))
