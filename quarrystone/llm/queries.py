"""Queries of the training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import chat as _chat
from quarrystone.llm import embedding_dedup as _embedding
from quarrystone.llm import exact_dedup as _exact
from quarrystone.llm import license_scan as _license
from quarrystone.llm import mixing as _mixing
from quarrystone.llm import ngram_join as _ngram
from quarrystone.llm import packing as _packing
from quarrystone.llm import quality as _quality
from quarrystone.llm import substring_dedup as _substring
from quarrystone.llm import token_files as _token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram.jaccard_components(_table(spark, sf_dir, "documents"), width=3, part=90, whole=100)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.license_scan(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_sequences(_table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.repeated_passages(_table(spark, sf_dir, "documents"), min_words=50)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_files.token_round_trip(_table(spark, sf_dir, "documents"), VOCABULARY)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(
        [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))],
        turns.schema)
    return _chat.read_back(_chat.format_conversations(turns.unionByName(own)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix_table(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_files": op6_token_files,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op1_ngram_join": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM words),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT u, v FROM common WHERE 100 * c >= 90 * (n + m - c)),
        twoway AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach(u, v) AS (SELECT u, v FROM twoway UNION SELECT r.u, b.v FROM reach r JOIN twoway b ON r.v = b.u)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(v) FROM reach WHERE reach.u = sets.doc_id), doc_id)) AS component_id FROM sets""",
    "op9_embedding_dedup": r"""
        WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (SELECT * FROM x WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
        reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
        low AS (SELECT u, min(v) AS v FROM reach GROUP BY u), many AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(v, vec_id)) AS component_id, least(vec_id, coalesce(v, vec_id)) = vec_id AS kept
        FROM x LEFT JOIN many ON vec_id = many.u LEFT JOIN low ON vec_id = low.u""",
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        g AS (
          SELECT norm, count(*) AS group_size,
                 arg_min(doc_id, struct_pack(a := -length(t), b := doc_id)) AS keep_id
          FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
               d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
}
