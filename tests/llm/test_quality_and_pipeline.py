import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarrystone.llm import mixing, quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, quality.train(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "a", 5.0), (None, "b c", 5.0), (4, "z" * 200_000, 5.0), (4, "\n\n", 5.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    none = quality.train(docs, labels.limit(0))
    out = quality.score(docs, none).collect()
    assert len(out) == 6 and all(r["score"] == 0.5 for r in out)
    assert quality.score(docs, quality.train(docs, labels)).count() == 6
    assert quality.score(docs.limit(0), none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs, none).count() == 6


def test_lookup_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.AdditiveModel(rounds=20, pair_rounds=120).fit(x[:3000], y[:3000])
    assert (3, 7) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on all that its predecessor kept, compared with a plain version of its decision."""
    import re

    from test_similarity import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "exact_dedup", "ngram_join", "mixing", "best_fit_packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def run(name, given):
        from quarrystone.llm.common import materialise

        out = materialise(steps[name](spark, given, sf), f"stage-test-{name}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        return out

    good = run("quality_classifier", docs)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {i for i, t in texts.items() if model.score(np.array([quality.features((t or "").encode())]))[0] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good.collect()} == want

    exact = run("exact_dedup", good)
    groups = {}
    for i in want:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append((-len(texts[i] or ""), i))
    want = {min(g)[1] for g in groups.values()}
    assert {r["doc_id"] for r in exact.collect()} == want

    near = run("ngram_join", exact)
    found = brute([(i, texts[i]) for i in sorted(want)], 5, 80, 100)
    want = {i for i, (_, c) in found.items() if c == i}
    assert {r["doc_id"] for r in near.collect()} == want

    mixed = run("mixing", near)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_table(near).collect()}
    assert set(copies) == want
    count = Counter(r["doc_id"] for r in mixed.collect())
    assert count == Counter({k: v for k, v in copies.items() if v})

    packed = run("best_fit_packing", mixed).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(tok.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in count}
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == Counter({i: total[i] * n for i, n in count.items()})

    whole = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)
