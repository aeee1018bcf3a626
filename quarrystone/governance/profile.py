"""Quality profiles in one pass, their failure codes, and the publication decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.dedupe import deterministic_sample


@dataclass(frozen=True)
class QualityContract:
    business_key: tuple[str, ...]
    minimum_rows: int = 1
    maximum_duplicates: int = 0
    maximum_null_keys: int = 0
    maximum_rejected_rate: float = 0.0
    safe_sample_columns: tuple[str, ...] = ()
    sample_size: int = 5

    def __post_init__(self):
        if not self.business_key:
            raise ValueError("a business key has one column at least")
        if not 1 <= self.sample_size <= 20:
            raise ValueError("sample_size is from 1 to 20")
        if not 0 <= self.maximum_rejected_rate <= 1:
            raise ValueError("maximum_rejected_rate is from 0 to 1")


def profile(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row in one aggregation: rows, distinct keys, null keys, duplicates, and nulls by column.

    A key with any null is a null key and not counted as distinct, so
    duplicates are rows less null keys less distinct keys.
    """
    some_null = F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)) == 1
    columns = list(df.columns if columns is None else columns)
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(*[F.col(k) for k in key]).alias("distinct_keys"),
                 F.count_if(some_null).alias("null_keys"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns])
    return one.withColumn("duplicate_keys", F.greatest(
        F.col("row_count") - F.col("null_keys") - F.col("distinct_keys"), F.lit(0)))


def rejected_rate(rows: int, rejected: int) -> float:
    return rejected / (rows + rejected) if rows + rejected else 0.0


def failure_codes(contract: QualityContract, columns: Sequence[str], rows: int = 0, duplicates: int = 0,
                  null_keys: int = 0, rate: float = 0.0) -> list[str]:
    """Codes in their fixed order; without the key columns nothing else can be said."""
    codes = []
    if any(k not in columns for k in contract.business_key):
        codes.append("MISSING_BUSINESS_KEY_COLUMN")
    if any(c not in columns for c in contract.safe_sample_columns):
        codes.append("MISSING_SAFE_SAMPLE_COLUMN")
    if "MISSING_BUSINESS_KEY_COLUMN" in codes:
        return codes
    tests = (("ROW_COUNT_BELOW_MINIMUM", rows < contract.minimum_rows), ("DUPLICATE_BUSINESS_KEY", duplicates > contract.maximum_duplicates),
             ("NULL_BUSINESS_KEY", null_keys > contract.maximum_null_keys), ("REJECTED_RATE_EXCEEDED", rate > contract.maximum_rejected_rate))
    return codes + [code for code, fails in tests if fails]


def evaluate(df: DataFrame, contract: QualityContract, rejected: int = 0) -> dict:
    """The profile's numbers, failure codes, and a sample of the columns that may be shown."""
    codes = failure_codes(contract, df.columns, rows=contract.minimum_rows)
    if "MISSING_BUSINESS_KEY_COLUMN" in codes:
        return {"passed": False, "codes": codes, "sample": []}
    row = profile(df, contract.business_key, contract.business_key).first()
    rate = rejected_rate(row["row_count"], rejected)
    codes = failure_codes(contract, df.columns, row["row_count"], row["duplicate_keys"], row["null_keys"], rate)
    safe = [c for c in contract.safe_sample_columns if c in df.columns]
    sample = [r.asDict() for r in deterministic_sample(df, contract.sample_size, safe).collect()] if safe else []
    return {"passed": not codes, "codes": codes, "row_count": row["row_count"], "distinct_keys": row["distinct_keys"],
            "duplicate_keys": row["duplicate_keys"], "null_keys": row["null_keys"], "rejected_rate": rate, "sample": sample}


def publication_decision(schema_faults: Sequence[str], row_count: int, reconciled: bool, null_keys: int,
                         duplicate_keys: int) -> tuple[str, str]:
    """(PUBLISHED or HELD, reason); the first fault in a fixed order decides."""
    for fails, reason in ((bool(schema_faults), "SCHEMA_INCOMPATIBLE"), (row_count == 0, "EMPTY_GOLD"),
                          (not reconciled, "RECONCILIATION_MISMATCH"), (null_keys > 0, "NULL_BUSINESS_KEY"),
                          (duplicate_keys > 0, "DUPLICATE_GRAIN")):
        if fails:
            return "HELD", reason
    return "PUBLISHED", "ALL_CHECKS_PASSED"
