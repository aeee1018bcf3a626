"""Batch readers.  Raw text is kept as text; types come with explicit schemas or casts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.clean import identifier


@dataclass(frozen=True)
class Source:
    """A named input: where it is, its format, and an explicit schema if it has one."""

    name: str
    path: str
    format: str = "csv"
    schema: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by a checked name."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": identifier(name)})


def load(spark: SparkSession, path: str, format: str, schema: str | None = None) -> DataFrame:
    """csv as text (or by ``schema``), multi-line json, or parquet; other formats raise ValueError."""
    if format == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    if format == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    if format == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"unsupported format: {format}")


def typed_csv(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """A reference CSV with columns cast by name; what can't be cast becomes null."""
    raw = load(spark, path, "csv")
    return raw.select(*[F.trim(F.col(c)).try_cast(k).alias(c) for c, k in kinds.items()])


def stamped(df: DataFrame, run_id: str, source: str | None = None) -> DataFrame:
    """Bronze audit columns: when, which run and which file (its name, or ``source``)."""
    name = F.lit(source) if source else F.col("_metadata.file_name")
    return df.select("*", F.current_timestamp().alias("_ingested_at"), name.alias("_source"), F.lit(run_id).alias("_run_id"))


def stamped_with_path(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_source_path"), F.current_timestamp().alias("_ingested_at"))


def ingest(spark: SparkSession, sources: list[Source], run_id: str, write) -> dict[str, int]:
    """Each source to bronze by ``write(name, frame)``; row counts come from the write itself."""
    from pyspark.sql import Observation

    counts = {}
    for s in sources:
        seen = Observation(f"rows_{s.name}")
        df = stamped(load(spark, s.path, s.format, s.schema), run_id, s.path.rsplit("/", 1)[-1])
        write(s.name, df.observe(seen, F.count(F.lit(1)).alias("n")))
        counts[s.name] = seen.get["n"]
    return counts
