"""A corpus pipeline: five training-data operators, one after another, over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; a runner
writes it and reads it again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import materialise, release, written
from quarrystone.llm.exact_dedup import keep_one
from quarrystone.llm.mixing import mixed_documents
from quarrystone.llm.ngram_join import keep_first
from quarrystone.llm.packing import pack_sequences
from quarrystone.llm.quality import keep_good, train


_before: dict[str, frozenset[str]] = {}  # tables that an application had when its pipeline began


def _begin(spark: SparkSession, docs: DataFrame, first: bool = False) -> None:
    """Free this pipeline's tables of the stage before, unless ``docs`` still reads them.

    One pipeline runs at a time in an application.
    """
    app = spark.sparkContext.applicationId
    if first:
        _before[app] = frozenset(written(spark))
    elif not any("/quarrystone/" in f and "/stage-" not in f for f in docs.inputFiles()):
        release(spark, [p for p in written(spark) if p not in _before.get(app, ())])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _begin(spark, docs, first=True)
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest original stays."""
    _begin(spark, docs)
    return keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams at a similarity of 0.8, the smallest id stays."""
    _begin(spark, docs)
    return keep_first(docs, width=5, part=80, whole=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    _begin(spark, docs)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix, packed into sequences of 2048 tokens."""
    _begin(spark, docs)
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: A learned classifier and a packing by linear program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
