"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are put in a random order by a hash and cut into blocks.
A source's target is a number of passes over it plus a part of one more; the
part is whole blocks in that order and, in the one block where it ends, the
documents that fill it best.  The blocks that every source gives are an exact
quota.  A binary tree splits the vector of quotas between output shards, each
time by one multivariate-hypergeometric draw; each task walks down to its own
shards.  A shard takes the next blocks of each source's order, so no block is
drawn twice in a pass, and orders its documents by another hash.  How often a
document is taken is how many draws of its block there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 256
SHARE = 1.5
MOST_PASSES = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
SHARD_BLOCKS = 64
BROADCAST_SOURCES = 20_000
RUN = 4096  # blocks that are summed together first


def targets(sizes: list[float], share: float = SHARE, most: float = MOST_PASSES,
            weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Words that each source gives; sources in code point order weigh ``weights``, repeating.

    A share above ``most`` times its source's size stops there; the excess goes
    to the others by weight until none is above.
    """
    n = len(sizes)
    weight = np.array([weights[k % len(weights)] for k in range(n)])
    size = np.array(sizes, float)
    target, free, rest = np.zeros(n), np.ones(n, bool), share * size.sum()
    while free.any():
        split = rest * weight / weight[free].sum()
        over = free & (split > most * size)
        if not over.any():
            target[free] = split[free]
            break
        target[over] = most * size[over]
        rest -= target[over].sum()
        free &= ~over
    return target.tolist()


def deal(quotas: np.ndarray, shards: int, seed: int, first: int, last: int):
    """The shards from ``first`` to ``last``: number, sources drawn from, first draw of each and draws of each.

    Quotas (draws by source) are split in two again and again; a part of the
    tree without a wanted shard is not entered, and draws depend on the place in
    the tree alone, so any task deals a shard alike.
    """
    todo = [(0, shards, np.arange(len(quotas)), np.zeros(len(quotas), np.int64), quotas.astype(np.int64))]
    while todo:
        lo, hi, which, start, here = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, which, start, here
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take = int(here.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(here, take, method="marginals") if take else np.zeros_like(here)
        for a, b, begin, own in ((mid, hi, start + left, here - left), (lo, mid, start, left)):
            some = own > 0
            todo.append((a, b, which[some], begin[some], own[some]))


def fill(sizes: list[int], room: int, exact: int = 1 << 16) -> list[int]:
    """Indexes of sizes that together come as near to ``room`` as they can without passing it.

    In order as long as much room is left, then by all sums that the others can have.
    """
    taken, rest = [], []
    for k, size in enumerate(sizes):
        if size <= room and room > exact:
            taken.append(k)
            room -= size
        else:
            rest.append(k)
    room = max(room, 0)
    sums, mask, grown = 1, (1 << (min(room, exact) + 1)) - 1, []
    for k in rest:
        more = (sums | sums << sizes[k]) & mask if sizes[k] <= exact else sums
        if more != sums:
            grown.append((k, sums))
            sums = more
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    for k, before in reversed(grown):
        if not before >> at & 1:
            taken.append(k)
            at -= sizes[k]
    return taken


def mark(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` as one struct, with its source and its place in the random order.

    Rows alike in id, source and text have the same place and go together.
    """
    return docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("no_source"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), F.col(text_col)).alias("h"))


def blocked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns and their block: the hash as a fraction of its range, times the blocks."""
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    return rows.join(sources, ["no_source", "source"]).withColumn("block", F.floor(place * F.col("n_blocks")))


class Plan(NamedTuple):
    sizes: DataFrame    # doc_id, size, h and source of each row
    sources: DataFrame  # a row for each source
    draws: DataFrame    # k, pass, block, shard, partial: a row for each drawn block
    fits: DataFrame     # k, h: what a partial draw takes


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11,
         weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> Plan:
    """What each shard draws.  The driver holds one row per source, never anything per document, block or shard."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialise(mark(docs.select(*{id_col, text_col, source_col}), id_col, text_col, source_col, seed).select(
        "doc_id", "source", "no_source", "h", words.alias("size")), "sizes")
    key = ["no_source", "source"]
    totals = rows.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = totals.orderBy(*key).toPandas()  # one row per source; null last
    sources["target"] = targets(sources["source_size"].tolist(), share, most, weights)
    size = np.maximum(sources["source_size"].to_numpy(float), 1)
    sources["passes"] = np.floor(sources["target"] / size).clip(0, most).astype(np.int64)
    part = (sources["target"] - sources["passes"] * sources["source_size"]).clip(lower=0)
    sources["part"] = np.where(part < 0.5, 0, part.round()).astype(np.int64)
    sources["n_blocks"] = np.maximum(1, sources["n_docs"] // BLOCK_DOCS)
    sources["k"] = np.arange(len(sources))
    columns = "no_source boolean, source string, k long, source_size long, target double, part long, n_blocks long"
    table = _bounded(spark.createDataFrame(sources[[c.split()[0] for c in columns.split(", ")]], columns), len(sources))
    placed = blocked(rows, table)
    # words before each block in its source's order, from one row per block and one per run of blocks
    blocks = materialise(placed.groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("part").alias("part")).withColumn(
        "run", F.floor(F.col("block") / RUN)), "blocks")
    runs = blocks.groupBy("k", "run").agg(F.sum("words").alias("all"))
    runs = runs.select("k", "run", (F.sum("all").over(Window.partitionBy("k").orderBy("run")) - F.col("all")).alias("base"))
    before = F.col("base") + F.sum("words").over(Window.partitionBy("k", "run").orderBy("block")) - F.col("words")
    blocks = blocks.join(runs, ["k", "run"]).select("k", "block", "part", "words", before.alias("before")).where("before < part")
    ends = blocks.groupBy("k").agg(F.max("block").alias("end"), F.max_by(
        F.struct((F.col("before") + F.col("words") > F.col("part")).alias("cut"), (F.col("part") - F.col("before")).alias("room")),
        "block").alias("last")).select("k", "end", "last.cut", "last.room").toPandas()  # one row per source at most
    sources = sources.merge(ends, on="k", how="left")
    end = sources["end"].fillna(-1).to_numpy(np.int64)
    cut = sources["cut"].eq(True).to_numpy()
    quotas = (sources["passes"] * sources["n_blocks"]).to_numpy(np.int64) + end + 1
    shards = max(1, -(-int(quotas.sum()) // SHARD_BLOCKS))

    def dealt(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                for shard, which, start, own in deal(quotas, shards, seed, int(ids[0]), int(ids[-1]) + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(start), pa.array(start + own - 1),
                                                      pa.array(np.full(len(which), shard))], names=["k", "low", "high", "shard"])

    edges = pd.DataFrame({"k": sources["k"], "n_blocks": sources["n_blocks"], "passes": sources["passes"],
                          "edge": np.where(cut, end, -1), "room": sources["room"].fillna(0).astype(np.int64)})
    edges = _bounded(spark.createDataFrame(edges, "k long, n_blocks long, passes long, edge long, room long"), len(sources))
    ranges = spark.range(0, shards, 1, max(1, min(shards // 64, spark.sparkContext.defaultParallelism))).mapInArrow(
        dealt, "k long, low long, high long, shard long")
    draws = ranges.join(edges, "k").select(
        "k", "n_blocks", "passes", "edge", "shard", F.explode(F.sequence("low", "high")).alias("j")).select(
        "k", F.floor(F.col("j") / F.col("n_blocks")).alias("pass"), F.pmod("j", "n_blocks").alias("block"), "shard", "passes", "edge")
    draws = materialise(draws.select("k", "pass", "block", "shard", (
        (F.col("pass") == F.col("passes")) & (F.col("block") == F.col("edge"))).alias("partial")), "draws")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h"])
        return frame.iloc[fill(frame["size"].tolist(), int(frame["room"].iloc[0]))][["k", "h"]]

    last = placed.drop("n_blocks").join(edges, "k").where(F.col("block") == F.col("edge"))
    fits = materialise(last.groupBy("k", "h").agg(F.sum("size").alias("size"), F.first("room").alias("room")).groupBy(
        "k").applyInPandas(fit, "k long, h long"), "fits")
    return Plan(rows, table, draws, fits)


def _bounded(table: DataFrame, n: int) -> DataFrame:
    """A table of one row a source; of a checked size it is broadcast, else it takes an ordinary join."""
    return F.broadcast(table) if n <= BROADCAST_SOURCES else table


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``.

    Words are runs outside ``[\\x20\\x09-\\x0D]``; null text has none, and a null
    source is a source of its own, the last.  Rows that repeat an id are
    documents of their own; those alike in id, source and text are taken
    equally often.  An empty table gives no rows.
    """
    sizes, sources, draws, fits = plan(docs, **options)
    per_block = draws.groupBy("k", "block").agg(F.count_if(~F.col("partial")).alias("whole"), F.count_if("partial").alias("partial"))
    copies = F.coalesce(F.col("whole") + F.when(F.col("fit"), F.col("partial")).otherwise(0), F.lit(0))
    return blocked(sizes, sources).join(per_block, ["k", "block"], "left").join(
        fits.withColumn("fit", F.lit(True)), ["k", "h"], "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))


def mix_draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11,
              **options) -> DataFrame:
    """One row per drawn copy: ``row`` (the columns of ``docs``), ``shard`` and ``at``, which orders a shard's copies."""
    _, sources, draws, fits = plan(docs, id_col, text_col, source_col, seed, **options)
    rows = blocked(mark(docs, id_col, text_col, source_col, seed), sources).select("row", "k", "block", "h")
    # drawn blocks are as many as documents need, never broadcast by us; hot blocks are split as any skewed join
    drawn = rows.join(draws, ["k", "block"]).join(fits.withColumn("fit", F.lit(True)), ["k", "h"], "left")
    return drawn.where(~F.col("partial") | F.col("fit")).select(
        "row", "shard", F.xxhash64(F.lit(seed + 1), "h", "pass").alias("at"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are drawn, with their columns, shard by shard in local order.

    Documents without words are taken as their block is.  Null ids, texts and
    sources, repeated rows and empty tables are as in ``mix_table``.
    """
    drawn = mix_draws(docs, **options)
    return drawn.repartition("shard").sortWithinPartitions("shard", "at").select("row.*")
