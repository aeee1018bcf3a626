"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text without white space is cut where its own content says so; the distinct
chunks become verified identifiers, and two texts are equal exactly when their
ordered identifier lists are.  Chunk contents move through the cluster once,
after map-side deduplication; everything later moves eight bytes a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import materialise

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
MIN_CHUNK, MAX_CHUNK = 1024, 8192
# Letters dealt into three classes; six letters of the classes in this order end
# a chunk, about once in 3**6 places, wherever the text around has moved to.
_A, _B, _C = "[adgjmpsvyADGJMPSVY]", "[behknqtwzBEHKNQTWZ]", "[cfiloruxCFILORUX]"
CUT = _A + _B + _C + _A + _B + _C
CHUNKS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT}|.{{1,{MAX_CHUNK}}}"


def without_white(text: Column) -> Column:
    """``text`` without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: its chunks, their hashes, digest and length."""
    flat = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_code_points"),
        without_white(F.col(text_col)).alias("norm"))
    cut = flat.select(
        "doc_id", "n_code_points",
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
        F.regexp_extract_all(F.col("norm"), F.lit(CHUNKS), F.lit(0)).alias("chunks"))
    return materialise(cut.select(
        "*", F.transform("chunks", lambda c: F.xxhash64(c)).alias("hashes")), "chunks")


def verified_recipes(cut: DataFrame) -> DataFrame:
    """``doc_id, n_code_points, text_sha256, recipe``: ordered verified chunk identifiers.

    Every distinct (hash, content) pair is gathered; a hash that stands for one
    content is that chunk's identifier.  A hash with several contents (a
    collision) is replaced by the hash followed by the content itself with its
    length before it, so equal lists of identifiers always mean equal contents,
    also when they are joined to one string.
    """
    pairs = cut.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("c")).select(
        F.col("c.hashes").alias("h"), F.col("c.chunks").alias("chunk"))
    distinct = pairs.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    clash = materialise(
        distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents"))
        .where("contents > 1").select("h"), "clash")
    narrow = cut.select("doc_id", "n_code_points", "text_sha256", F.col("hashes").alias("recipe"))
    if clash.isEmpty():
        return narrow.withColumn("recipe", F.transform("recipe", lambda h: F.hex(h)))
    # Exact way for colliding hashes: their chunks are identified by content.
    rows = cut.select(F.monotonically_increasing_id().alias("_row"), "*")
    rows = materialise(rows, "chunk_rows")
    parts = rows.select("_row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("pos", "c")).select(
        "_row", "pos", F.col("c.hashes").alias("h"), F.col("c.chunks").alias("chunk"))
    marked = parts.join(clash.withColumn("_clash", F.lit(True)), "h", "left").select(
        "_row", "pos", F.when(F.col("_clash"), F.concat(F.hex("h"), F.lit(":"), F.length("chunk"), F.lit(":"), "chunk"))
        .otherwise(F.hex("h")).alias("part"))
    lists = marked.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("l"))
    return rows.select("_row", "doc_id", "n_code_points", "text_sha256").join(lists, "_row", "left").select(
        "doc_id", "n_code_points", "text_sha256",
        F.coalesce(F.transform("l", lambda x: x["part"]), F.array().cast("array<string>")).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts form a group; the row with the most code points in its original
    text stays, then the smallest ``doc_id`` (a null id comes last).  Null and
    empty texts are equal to each other.  Rows that repeat a ``doc_id`` each
    count in ``group_size``; rows with the kept id are all marked kept.  An
    empty table gives an empty result.  Other input columns are ignored.
    """
    recipes = verified_recipes(chunked(docs, id_col, text_col))
    # The list is compared as one string: identifiers are hexadecimal and joined by commas.
    keyed = recipes.select("doc_id", "n_code_points", "text_sha256",
                           F.concat_ws(",", "recipe").alias("recipe"))
    best = keyed.groupBy("recipe").agg(
        F.min_by("doc_id", F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), "doc_id")).alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"))
    return keyed.join(best, "recipe").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_keep"]), "left_semi")
