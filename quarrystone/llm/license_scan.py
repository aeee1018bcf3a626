"""License scans by diagonal voting (DataFrame functions only).

All rolling word pairs of a text are hashed; those with the hash of a template's
pair are joined to the places of the same pairs in the templates, by the hash and
then by the words themselves, so that no hit rests on a hash.  A hit at word p of the text and q of a template
votes for the diagonal p - q.  Full diagonals of the short base phrases are
exact occurrences; neighbouring diagonals of a longer template are merged, so
that inserted or lost words do not break a notice, and the merged span is
verified by how much of the template it covers and how long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phrases of the base labels, word by word.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Longer public notices that the method labels even when changed.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the"
     " gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution license", "cc-by"),
)
K = 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTINEL = 0


def _templates(spark) -> DataFrame:
    """A row for each template place; a fixed, small table.  Template -1 marks a text's end."""
    rows = [(-1, "", True, 0, "", "", 0)]  # no word is empty
    for t, (text, label) in enumerate([*BASE, *NOTICES]):
        words = text.split()
        rows += [(t, label, t < len(BASE), q, words[q], words[q + 1], len(words))
                 for q in range(len(words) - 1)]
    made = spark.createDataFrame(rows, "tmpl int, label string, base boolean, q int, a string, b string, m int")
    return made.select("tmpl", "label", "base", "q", "m", "a", "b",
                       F.when(F.col("tmpl") < 0, F.lit(SENTINEL).cast("long"))
                       .otherwise(F.xxhash64("a", "b")).alias("h"))


def words_of(text):
    """Words of a text, A-Z lower-cased; no word for null or empty.

    ``lower`` also changes other letters, which stay word characters; the two
    letters that it would turn into ASCII ones take the slower exact way.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    low = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NOT_WORD), "")


def pairs(words: DataFrame) -> DataFrame:
    """Of all rolling word pairs of ``w`` those with the hash of a template's, and a row at the end of each text.

    Only a pair with such a hash becomes a row, so a text's other words leave no
    garbage but their hashes.  Id, key and two words pass the generator: a text
    must not be copied for each word.
    """
    known = sorted({pair for text, _ in (*BASE, *NOTICES) for pair in zip(text.split(), text.split()[1:])})
    hashes = ", ".join(f"xxhash64('{a}', '{b}')" for a, b in known)
    return words.select("rk", "doc_id", F.explode(F.expr(f"""concat(
        array_compact(transform(w, (x, i) -> CASE WHEN xxhash64(x, get(w, i + 1)) IN ({hashes}) THEN
            struct(i AS p, xxhash64(x, get(w, i + 1)) AS h, x AS a, coalesce(get(w, i + 1), '') AS b) END)),
        array(struct(size(w) AS p, {SENTINEL}L AS h, '' AS a, '' AS b)))""")).alias("g")).select("rk", "doc_id", "g.*")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_shift: int = 2, min_cover: float = 0.75) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the largest covered part of any template, 0 without a hit.  A
    null or empty text has no words and no labels (empty strings).  Rows that
    repeat an id are scanned and returned one by one.
    """
    words = docs.select(F.monotonically_increasing_id().alias("rk"), F.col(id_col).alias("doc_id"),
                        words_of(F.col(text_col)).alias("w"))
    hits = pairs(words).join(F.broadcast(_templates(docs.sparkSession)), ["h", "a", "b"]).select(
        "rk", "doc_id", "p", "tmpl", "label", "base", "q", "m")
    key = ["rk", "doc_id"]
    diagonals = hits.repartition("rk").groupBy(
        *key, "tmpl", "label", "base", "m", (F.col("p") - F.col("q")).alias("diag")).agg(
        F.max("p").alias("last_p"), F.min("p").alias("first_p"),
        F.bit_or(F.expr("shiftleft(1L, q)")).alias("seen"))
    order = Window.partitionBy(*key, "tmpl").orderBy("diag")
    far = (F.col("diag") - F.lag("diag").over(order)) > max_shift
    runs = diagonals.withColumn("new", F.coalesce(far.cast("int"), F.lit(1))).withColumn(
        "run", F.when(F.col("base"), F.col("diag")).otherwise(F.sum("new").over(order)))
    spans = runs.groupBy(*key, "tmpl", "label", "base", "m", "run").agg(
        F.bit_or("seen").alias("seen"), F.max("last_p").alias("last_p"), F.min("first_p").alias("first_p"),
        F.min("diag").alias("start"))
    cover = F.bit_count("seen") / (F.col("m") - 1)
    short = (F.col("last_p") - F.col("first_p") + K) <= F.col("m") * 2
    spans = spans.select(*key, "tmpl", "label", "base", "last_p", "start", cover.alias("cover"),
                         (F.col("base") & (F.col("tmpl") >= 0) & (cover == 1)).alias("exact"),
                         (~F.col("base") & short & (cover >= min_cover)).alias("fuzzy"), short.alias("short"))
    joined = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, F.col("label")))))
    return spans.groupBy(*key).agg(
        F.max(F.when(F.col("tmpl") < 0, F.col("last_p"))).cast("long").alias("n_words"),
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.col("exact")).alias("base_labels"),
        joined(F.col("exact") | F.col("fuzzy")).alias("labels"),
        F.coalesce(F.max(F.when((F.col("tmpl") >= 0) & F.col("short"), F.col("cover"))), F.lit(0.0)).alias("score"),
    ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
