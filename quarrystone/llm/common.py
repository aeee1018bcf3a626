"""Shared pieces of the training-data operators: scratch tables and components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KEPT = "stage-"
CODECS = {"words": "zstd"}  # by name of an intermediate table; others take the session's
_WRITTEN: dict[str, list[str]] = {}  # by application


def written(spark: SparkSession) -> list[str]:
    """Paths of this application's intermediate tables so far."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete intermediate tables.

    Only for a point where no result that reads them is still to be written,
    such as the start of a stage whose input was written and read again.
    """
    jvm, known = spark._jvm, written(spark)
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in known:
            known.remove(name)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster.  Where that is unset it is
    a folder of the warehouse, which all executors share too.  Only a session
    that runs in one process may use a temporary folder of its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_quarrystone_scratch", None)
        if not base:
            if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                base = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
            else:
                base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            spark._quarrystone_scratch = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted as this application's."""
    path = f"{scratch_dir(spark)}/quarrystone/{name}-{uuid.uuid4().hex}"
    if not name.startswith(KEPT):
        written(spark).append(path)
    return path


def materialise(df: DataFrame, name: str, partition_hint: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors: the files are
    committed by Spark's writer, and later stages reread them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.coalesce(partition_hint) if partition_hint else df).write.parquet(path, compression=CODECS.get(name))
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan needs any more.

    Its cleaner learns of them only when the driver collects its garbage,
    which a driver that does little else may put off until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for undirected ``edges(u, v)``; component = smallest node.

    Alternating large-star and small-star rounds: every round is two
    aggregations and joins on the edge list, and the number of rounds grows
    with the logarithm of the longest path.  Hubs are safe: minima are taken
    with map-side aggregation and a hub's neighbour list is never collected.
    Nodes without edges do not appear.  Each round is written to the shared
    scratch folder, so neither the lineage nor the driver grows.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = materialise(tidy(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))), "cc")
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select(
            "u", F.least("u", "m0").alias("m"))
        # large star: every larger neighbour of u moves to u's minimum
        large = tidy(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large, "cc")
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        nxt = materialise(tidy(small), "cc")
        # stars only: no node is both a leaf and a centre, and every leaf has one centre
        chained = nxt.select("u").join(nxt.select(F.col("v").alias("u")), "u", "left_semi")
        split = nxt.groupBy("u").count().where("count > 1")
        if chained.isEmpty() and split.isEmpty():
            current = nxt
            break
        current = nxt
    else:
        raise RuntimeError("components did not settle")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
