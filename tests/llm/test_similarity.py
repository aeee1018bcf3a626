import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarrystone.llm import embedding_dedup, ngram_join, queries
from quarrystone.llm.common import connected_components


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000 + k) for k in range(200)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = components(pairs, nodes)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1)))


def brute(rows, width, part, whole):
    sets = {i: shingles(t, width) for i, t in rows}
    index, pairs = defaultdict(list), []
    for i, s in sets.items():
        common = Counter(j for e in s for j in index[e])
        pairs += [(i, j) for j, n in common.items() if whole * n >= part * (len(s) + len(sets[j]) - n)]
        for e in s:
            index[e].append(i)
    found = components(pairs, sets)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def planted():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 12, 30, 90, 300, 900]))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    hub = [rng.choice(words) for _ in range(120)]
    for k in range(700):  # one large group of near copies, many of them not linked directly
        copy = list(hub)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words) + str(k)
        rows.append((2000 + k, " ".join(copy)))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (5003, "One"), (5004, "one"), (5005, "É one"), (5006, "é one"), (5007, "x " * 5000), (5008, "x " * 4000)]


@pytest.mark.parametrize("width,part", [(3, 90), (5, 80)])
def test_jaccard_components_against_brute_force(spark, width, part):
    rows = planted()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, hub int, label string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, width, part, 100).collect()}
    assert got == brute(rows, width, part, 100)


def test_jaccard_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, "q r s t"), (3, "a b c d")], "doc_id long, text string")
    got = sorted(map(str, map(tuple, ngram_join.jaccard_components(df, 3, 90, 100).collect())))
    assert got == sorted(["(1, 2, 1)", "(1, 2, 1)", "(None, 2, None)", "(2, 2, 1)", "(3, 2, 1)", "(3, 2, 1)"])
    assert ngram_join.jaccard_components(df.limit(0), 3, 90, 100).count() == 0
    kept = ngram_join.keep_first(df.where("doc_id < 3"), 3, 90, 100)
    assert {r["doc_id"] for r in kept.collect()} == {1}


@pytest.mark.parametrize("part", [50, 80, 90])
def test_linked_sets_always_share_a_signature(part):
    """Sets that differ as much as a link allows, also where parts are empty or hold one shingle."""
    rng = np.random.default_rng(part)
    bands = ngram_join.Bands(part, 100)
    linked = 0
    for n in [*range(1, 40), 60, 100, 200, 300] * 12:
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        b = a[np.sort(rng.permutation(n)[:n - int(rng.integers(0, max(1, n * (100 - part) // 100 + 1)))])]
        most = max(0, 100 * len(b) // part - n)  # shingles of its own that b may have
        b = np.unique(np.concatenate([b, rng.integers(0, 2 ** 64, most, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < part * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        linked += 1
        sigs, owner = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
        assert len(np.intersect1d(sigs[owner == 0], sigs[owner == 1])), (len(a), len(b), common)
    assert linked > 100


def test_a_small_set_does_not_chain_larger_unrelated_ones():
    """One gathering of many sizes: only what may link stays together, or whole gatherings would move and move again."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in [20, *range(91, 700, 3)]]
    sets.append(np.sort(np.concatenate([sets[-1][:-30], rng.integers(0, 2 ** 63, 30).astype(np.uint64)])))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    held = ngram_join.sketches(np.concatenate(sets), at)
    label = ngram_join.possible_parts(np.diff(at), held, np.arange(len(held)), 80, 100)
    assert label[-1] == label[-2] and len(set(label.tolist())) == len(sets) - 1


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (12, 60, 400, 3000):
        base = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        sets = []
        for _ in range(30):
            keep = base[rng.random(n) > rng.choice([0.01, 0.05, 0.1])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2 ** 63, rng.integers(0, n // 10 + 1)).astype(np.uint64)])))
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        held = ngram_join.sketches(np.concatenate(sets), at)
        rough = ngram_join.possible_parts(np.diff(at), held, np.arange(len(held)), 90, 100)
        exact = ngram_join.linked_parts(sets, 90, 100)
        for a in range(len(sets)):
            assert len({rough[b] for b in np.flatnonzero(exact == exact[a])}) == 1


@pytest.mark.parametrize("name", ["op1_ngram_join", "op9_embedding_dedup"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_match_their_sql_over_whole_tables(spark, name, sf):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{table}.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, f"/root/testdata/{sf}").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def cosines(rows, least=0.95):
    good = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(
        c is not None and np.isfinite(c) for c in v) and any(v)]
    pairs = []
    for a, (i, u) in enumerate(good):
        for j, v in good[a + 1:]:
            if len(u) == len(v) and float(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                pairs.append((i, j))
    found = components(pairs, range(len(rows)))
    links = Counter(x for p in pairs for x in p)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[found[k]].append(i)
    return sorted((i, links[k], min(low[found[k]]), i == min(low[found[k]])) for k, (i, _) in enumerate(rows))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            rows.append((len(rows) * 13 % 2003, [float(np.float32(x)) for x in base * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.3])]))
    rows += [(3000 + k, rows[0][1]) for k in range(30)]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [1.0, None] * 8), (4004, [float("inf")] + [1.0] * 15), (4005, []),
             (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (4008, [1e-30] * 16)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert got == cosines(held)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id in (4000, 4001)")).count() == 2


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) * rng.uniform(0.01, 50, (300, 1))
    q, scale, lost = embedding_dedup.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    approx = embedding_dedup.integer_products(q, q) * scale[:, None] * scale[None, :]
    bound = (1 + lost[:, None]) * lost[None, :] + lost[:, None]
    assert (np.abs(unit @ unit.T - approx) <= bound + 1e-6).all()


@pytest.mark.parametrize("part, whole", [(90, 100), (80, 100)])
def test_bands_hold_sets_of_any_size(part, whole):
    bands = ngram_join.Bands(part, whole)
    for n in (1, 1000, (1 << 26) + 9, 1 << 27, 1 << 30, (1 << 31) - 1):
        low, high = bands.band(np.array([n, min(n * whole // part, (1 << 31) - 1)]))
        assert high - low <= 1
        assert bands.k[low] >= 2 * n * (whole - part) // (whole + part)
