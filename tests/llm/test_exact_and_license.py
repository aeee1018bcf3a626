import hashlib
import re

import duckdb
import pytest

from quarrystone.llm import exact_dedup, license_scan, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, recipe string, h long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "clash", 1) for i, t in rows], DOCS)


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "".join(f"wörd{k} aeghmdi " for k in range(30_000))
ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, LONG.replace(" ", "")), (9, LONG + "x"),
        (10, "x" * 30_000), (11, "x" * 29_999 + "y"), (12, "AB"), (13, "a b"), (14, "ab"), (14, "ab"), (15, "a b"), (16, "\x1cab")]


def test_colliding_chunks_that_hold_separators_stay_apart(spark, monkeypatch):
    """Chunks of one hash whose contents look like joined identifiers."""
    cut = [(1, ["a,7:b", "q"], [7, 5]), (2, ["a", "b", "q"], [7, 7, 5]), (3, ["a", "b", "q"], [7, 7, 5]), (4, [], []),
           (5, ["a,7:1:b", "q"], [7, 5])]
    df = spark.createDataFrame([(i, 9, "x", c, h) for i, c, h in cut],
                               "doc_id long, n_code_points long, text_sha256 string, chunks array<string>, hashes array<bigint>")
    monkeypatch.setattr(exact_dedup, "chunked", lambda *a: df)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (4, 1), 5: (5, 1)}


def test_exact_against_brute_force(spark):
    got = exact_dedup.exact_dedup(table(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)
    assert exact_dedup.exact_dedup(table(spark, ROWS).limit(0)).count() == 0


def test_colliding_hashes_are_told_apart(spark):
    from pyspark.sql import functions as F

    cut = exact_dedup.chunked(table(spark, ROWS))
    one = cut.withColumn("hashes", F.transform("hashes", lambda h: F.lit(7).cast("long")))
    recipes = exact_dedup.verified_recipes(one)
    norms = {tuple(r["recipe"]): set() for r in recipes.collect()}
    for r in recipes.collect():
        norms[tuple(r["recipe"])].add(r["text_sha256"])
    assert all(len(v) == 1 for v in norms.values()) and len(norms) == recipes.select("text_sha256").distinct().count()


def test_kept_rows_keep_their_columns(spark):
    kept = exact_dedup.keep_one(table(spark, ROWS[:13]))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7, 9, 10, 11, 12, 13]


def test_exact_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_exact_dedup"]).fetchall()
    got = queries.op8_exact_dedup(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w, places = words(text), []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
    return (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


TEXTS = [(1, "GNU General Public License."), (2, "the MIT license, mit\nLICENSE and CC-BY cc by cc"), (3, None), (4, ""), (5, "apache"),
         (6, "gnu general gnu general public license license"), (7, "mİt license K cc BY"), (8, "Apache é license apache License"),
         (9, "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software"), (10, "x " * 5000 + "mit license"),
         (11, "gnu general public foo license"), (12, "GNU Lesser General Public License"), (12, "mit license"), (13, "cc by cc by cc by")]


def test_license_base_against_brute_force(spark):
    got = license_scan.license_scan(table(spark, TEXTS))
    found = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got.collect() if r["doc_id"] != 12)
    assert found == sorted((i, *base(t)) for i, t in TEXTS if i != 12)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[9]["labels"] == "mit" and rows[9]["base_labels"] == ""
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows.values())
    assert rows[5]["score"] == 0 and rows[1]["score"] == 1 and got.count() == len(TEXTS)
    assert license_scan.license_scan(table(spark, TEXTS).limit(0)).count() == 0


def test_only_template_pairs_pass_the_generator(spark):
    from pyspark.sql import functions as F

    texts = [(1, "x " * 5000 + "mit license"), (2, None), (3, "a gnu general gnu"), (4, "license mit of the")]
    split = table(spark, texts).select(F.col("doc_id").alias("rk"), "doc_id", license_scan.words_of(F.col("text")).alias("w"))
    got = sorted((r["doc_id"], r["p"], r["a"], r["b"]) for r in license_scan.pairs(split).collect())
    assert got == [(1, 5000, "mit", "license"), (1, 5002, "", ""), (2, 0, "", ""), (3, 1, "gnu", "general"), (3, 4, "", ""),
                   (4, 2, "of", "the"), (4, 4, "", "")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_license_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    got = queries.op2_license_scan(spark, f"/root/testdata/{sf}").collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"] if r["n_base"] else -1) for r in got) == sorted(
        (d["doc_id"], *base(d["text"])[:2], base(d["text"])[2] if base(d["text"])[1] else -1) for d in docs)
