"""Token ids written as Simple-8b files in ascending document order, and read back.

A file row is a segment: the document ids, their lengths, and blocks of packed
ids with the places where each block begins.  Spark's writer commits the files,
so a lost executor leaves none half written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import simple8b
from quarrystone.llm.common import scratch_path
from quarrystone.llm.tokens import encoded

SEGMENT = "shard int, ids_before long, doc_ids array<bigint>, lengths array<bigint>, block_offsets array<bigint>, payload binary"
PER_DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents below ``path``.

    Documents are dealt by ranges of their id and sorted; a null id comes first
    and rows that repeat an id are ordered by their text's hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def pack(batches):
        shard, before = TaskContext.get().partitionId(), 0
        for keys, ids, at in encoded(batches, tokenizer_path):
            blocks = simple8b.encode(ids)
            sizes = np.cumsum([0, *map(len, blocks)])[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())), pa.array([np.diff(at)], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(blocks)], pa.binary()),
            ], names=["shard", "ids_before", "doc_ids", "lengths", "block_offsets", "payload"])
            before += len(ids)

    # Packed words hardly shrink further; storing them as they are keeps reading cheap.
    ordered.mapInArrow(pack, SEGMENT).write.option("compression", "lz4_raw").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # One number for each shard; there are as many shards as write tasks.
    last = files.groupBy("shard").agg(F.max(F.col("ids_before") + F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, total = {}, 0
    for row in sorted(last, key=lambda r: r["shard"]):
        base[row["shard"]] = total
        total += row["n"]

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before, keys, lengths, places, payload = (c[k].as_py() for c in batch.columns)
                ids = simple8b.decode(payload, places).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(starts + (base[shard] + before), pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(unpack, PER_DOCUMENT)


def token_round_trip(docs: DataFrame, tokenizer_path: str, name: str = "token-files") -> DataFrame:
    """Write the files to the shared scratch folder and return what they hold.

    Null or empty texts have the end id alone.  An empty table gives no rows.
    """
    path = scratch_path(docs.sparkSession, name)
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path)
