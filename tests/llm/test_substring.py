import random

import numpy as np
import pyarrow as pa

from quarrystone.llm import substring_dedup as sd
from quarrystone.llm.ngram_join import rolled_hashes


def test_every_window_gives_its_smallest_seed():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lens = rng.integers(0, 60, 6)
        first = np.concatenate([[0], np.cumsum(lens)])
        h = rng.integers(0, 2 ** 63, first[-1]).astype(np.uint64)
        value, text, place = sd.minimisers(h, first)
        got = set(zip(text.tolist(), place.tolist()))
        for d in range(6):
            x = h[first[d]:first[d + 1]]
            kmers = rolled_hashes(x, sd.K)[:max(0, len(x) - sd.K + 1)]
            assert all((d, j + int(kmers[j:j + sd.WINDOW].argmin())) in got for j in range(len(kmers) - sd.WINDOW + 1))


def best_scores(p, q):
    score = []
    for i in range(len(p)):
        before = [score[j] - sd.GAP_COST * (p[i] - p[j] + q[i] - q[j]) for j in range(i) if p[j] < p[i] and q[j] < q[i]]
        score.append(sd.WEIGHT + max([0.0, *before]))
    return score


def test_chains_are_the_best_ones():
    rng = random.Random(1)
    for _ in range(200):
        anchors = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(rng.randrange(1, 25))})
        p, q = [a for a, _ in anchors], [b for _, b in anchors]
        found = sd.chains(p, q)
        assert sorted(i for c in found for i in c) == list(range(len(p)))
        for c in found:
            assert all(p[a] < p[b] and q[a] < q[b] for a, b in zip(c, c[1:]))
        top = found[0]
        total = sd.WEIGHT * len(top) - sd.GAP_COST * (p[top[-1]] - p[top[0]] + q[top[-1]] - q[top[0]])
        assert abs(total - max(best_scores(p, q))) < 1e-9


def test_planted_passages_are_found(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs = {i: make(rng.randrange(5, 400)) for i in range(60)}
    places = {}

    def plant(i, passage):
        at = rng.randrange(len(docs[i]) + 1)
        docs[i][at:at] = passage
        places[i] = (at, at + len(passage))

    exact, longer, fuzzy, short = make(51), make(120), make(70), make(40)
    for i in (3, 9, 20):
        plant(i, exact)
    for i in (4, 5, 6, 30):
        plant(i, longer)
    for i in (11, 12):
        changed = list(fuzzy)
        for k in range(10, 70, 13):
            changed[k] = rng.choice(words)
        plant(i, changed)
    for i in (40, 41):
        plant(i, short)
    docs[100], docs[101] = ["x"] * 3000, ["x"] * 2000
    rows = [(i, " ".join(w), 1) for i, w in docs.items()] + [(None, "a", 1), (200, None, 1), (201, "", 1), (3, " ".join(docs[3]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p int")
    got = {(r["doc_id"], r["source_doc_id"]): r for r in sd.repeated_passages(df).collect()}
    assert {k for k in got if k[0] < 100} == {(9, 3), (20, 3), (5, 4), (6, 4), (30, 4), (12, 11)}
    for (i, j), r in got.items():
        if i in places:
            assert abs(r["start_word"] - places[i][0]) <= 2 and abs(r["end_word"] - places[i][1]) <= 2
            assert abs(r["source_start"] - places[j][0]) <= 2 and r["identity"] >= 0.9
    assert (101, 100) in got
    assert sd.repeated_passages(df.limit(0)).count() == 0


def test_two_passages_of_one_chain_are_both_found(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs, places = {}, {}
    for k in range(20):
        one, two, gap = make(60), make(60), rng.randrange(40, 121)
        for i in (2 * k, 2 * k + 1):
            docs[i] = make(30) + one + make(gap) + two + make(30)
        places[2 * k + 1] = [(30, 90), (90 + gap, 150 + gap)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = sd.repeated_passages(df).collect()
    assert len(got) == 40
    for i, spans in places.items():
        rows = sorted((r["start_word"], r["end_word"], r["source_start"], r["source_end"], r["matched_words"], r["identity"])
                      for r in got if r["doc_id"] == i and r["source_doc_id"] == i - 1)
        assert len(rows) == 2
        for (a0, a1, b0, b1, matched, identity), (lo, hi) in zip(rows, spans):
            assert a0 <= lo and hi <= a1 and a1 - a0 <= 66 and b0 <= lo and hi <= b1 and matched >= 60 and identity >= 0.8


def test_maximal_segments_against_the_definition():
    rng = random.Random(3)

    def positive(x):  # every prefix and suffix sums above nothing
        return all(sum(x[:k]) > 0 and sum(x[-k:]) > 0 for k in range(1, len(x) + 1))

    for _ in range(300):
        score = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 14))]
        good = [(i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1) if positive(score[i:j])]
        want = [x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good)]
        assert sd.maximal(score) == sorted(want)


def test_passages_whose_seeds_begin_in_different_documents(spark):
    rng = random.Random(17)
    words = [f"w{k}" for k in range(5000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs, spans = {}, {}
    for k in range(8):  # each half first in a document of its own
        whole = make(80)
        docs[10 * k + 1], docs[10 * k + 2] = make(20) + whole[:40] + make(20), make(9) + whole[40:] + make(20)
        docs[10 * k + 3], docs[10 * k + 4] = make(5) + whole + make(30), make(33) + whole
        spans[10 * k + 4] = (10 * k + 3, 33, 113, 5)
    for k in range(8, 16):  # the middle first, too short alone; the later two share more
        whole = make(56)
        docs[10 * k + 1] = make(20) + whole[12:46] + make(20)
        docs[10 * k + 3], docs[10 * k + 4] = make(5) + whole + make(30), make(33) + whole + make(4)
        spans[10 * k + 4] = (10 * k + 3, 33, 89, 5)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in sd.repeated_passages(df).collect()}
    assert got == {i: (i, a, b, s, q, q + b - a, b - a, 1.0) for i, (s, a, b, q) in spans.items()}


def test_every_repeated_run_of_the_least_length_is_covered(spark):
    rng = random.Random(23)
    words = [f"w{k}" for k in range(3000)]
    lines = [[rng.choice(words) for _ in range(rng.randrange(8, 45))] for _ in range(25)]
    docs = {i: [w for _ in range(rng.randrange(1, 9)) for w in rng.choice(lines)] for i in range(70)}
    docs[90] = docs[91] = ["x"] * 120
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    rows = sd.repeated_passages(df).collect()
    first = {}
    for i, w in sorted(docs.items()):
        for k in range(len(w) - 49):
            run = tuple(w[k:k + 50])
            if first.setdefault(run, i) != i:
                assert any(r["doc_id"] == i and min(r["end_word"], k + 50) > max(r["start_word"], k) for r in rows)
                held = {p for r in rows if r["doc_id"] == i for p in range(r["start_word"], r["end_word"])}
                assert held >= set(range(k, k + 50))
    for r in rows:
        assert r["source_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8


def test_wide_hashes_and_cover():
    rng = random.Random(29)
    h = np.array([rng.randrange(3) for _ in range(400)], np.uint64)
    for width in (1, 2, 7, 50):
        wide = sd.wide_hashes(h, width)
        runs = [tuple(h[k:k + width]) for k in range(len(h) - width + 1)]
        assert len(wide) == len(runs) and len(set(wide.tolist())) == len(set(runs)) == len(set(zip(runs, wide.tolist())))
    for _ in range(200):
        spans = [(s, s + rng.randrange(5, 20), 0) for s in (rng.randrange(60) for _ in range(rng.randrange(0, 12)))]
        kept = sd.cover(spans)
        points = lambda x: {p for a, b, _ in x for p in range(a, b)}
        assert points(kept) == points(spans) and set(kept) <= set(spans) and len(kept) == len(set(kept))


def test_changed_passages_whose_seeds_begin_in_different_documents(spark):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(5000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs, want = {}, {}
    for k in range(30):  # each half first in a document of its own, every 27th word or so changed in the last
        whole = make(100)
        changed = list(whole)
        for j in (24, 49, 50, 74):
            changed[j] = f"z{k}-{j}"
        base = 10 * k
        if k < 20:
            docs[base + 1], docs[base + 2] = make(20) + whole[:44] + make(20), make(9) + whole[53:] + make(20)
            docs[base + 3] = make(20) + whole[20:48] + make(5)  # and some of it just before
            docs[base + 4], docs[base + 5] = make(5) + whole + make(30), make(33) + changed
            want[base + 5] = (base + 4, 33, 133, 5)
        else:  # the earlier one has words that no other has, the later one meets another document first
            docs[base + 1] = make(5) + whole + make(30)
            docs[base + 5] = make(33) + changed
            want[base + 5] = (base + 1, 33, 133, 5)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {}
    for r in sd.repeated_passages(df).collect():
        assert r["doc_id"] in want and r["doc_id"] not in got
        got[r["doc_id"]] = (r["source_doc_id"], r["start_word"], r["end_word"], r["source_start"])
        assert r["source_end"] - r["source_start"] == 100 and r["matched_words"] == 96
    assert got == want


def test_two_seeds_and_places_amid_runs():
    rng = random.Random(37)
    for _ in range(50):
        text = np.sort(np.array([rng.randrange(3) for _ in range(60)]))
        place = np.concatenate([np.sort(rng.sample(range(400), int((text == t).sum()))) for t in range(3)]).astype(np.int32)
        seed = np.array([rng.randrange(4) for _ in text], np.uint64)
        marks = np.array([rng.randrange(4) for _ in text], np.int32)
        want = {}
        for i in range(60):
            for j in range(i + 1, 60):
                if text[i] == text[j] and 12 <= place[j] - place[i] <= sd.FAR:
                    k = (int(text[i]), int(seed[i]), int(seed[j]))
                    want[k] = want.get(k, 0) | int(marks[i] & marks[j])
        key, of, both = sd.two_seeds(seed, place, text, 12, marks)
        assert len(set(zip(key.tolist(), of.tolist()))) == len(key) == len(want)
        assert sorted(zip(of.tolist(), both.tolist())) == sorted((t, m) for (t, _, _), m in want.items())
    seed, place = np.array([5, 5, 5, 5, 7, 5, 9, 9, 9]), np.array([3, 4, 5, 6, 7, 9, 20, 30, 41])
    assert place[sd.ends(seed, place)].tolist() == [3, 6, 7, 9, 20, 30, 41]


def test_a_common_line_brings_no_pairs_of_unlike_documents(spark, monkeypatch):
    rng = random.Random(41)
    words = [f"w{k}" for k in range(5000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    line = make(38)
    docs, want = {i: make(rng.randrange(5, 60)) + line + make(rng.randrange(5, 60)) for i in range(1, 81)}, {}
    docs[0] = make(9) + line  # the first of the line is like none of them
    for k in range(100, 106):  # what stands beside the line repeats with changed words and has no seed
        beside = make(24)
        docs[k] = make(10) + line + beside + make(20)
        changed = list(beside)
        for j in (3, 8, 14, 19):
            changed[j] = f"z{k}-{j}"
        docs[k + 100] = make(30) + line + changed + make(15)
        want[k + 100] = (k, 30, 92, 10)
    written = {}

    def noted(df, name):
        out = materialise(df, name)
        written[name] = out.count()  # the last ones: chains of what no passage covers
        return out

    materialise = sd.materialise
    monkeypatch.setattr(sd, "materialise", noted)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    rows = sd.repeated_passages(df).collect()
    got = {r["doc_id"]: (r["source_doc_id"], r["start_word"], r["end_word"], r["source_start"]) for r in rows}
    assert got == want and len(rows) == len(want)
    assert written["chains"] <= len(docs)


def test_meetings_and_what_they_may_share():
    rng = random.Random(43)
    for most in (5, 1 << 16):
        sd.MEETINGS, before = most, sd.MEETINGS
        for _ in range(60):
            n = rng.randrange(1, 40)
            rows = sorted((rng.randrange(4), rng.randrange(8)) for _ in range(n))
            key, doc = (np.array(x, np.int64) for x in zip(*rows))
            marks = np.array([rng.choice((0, 0, 1, 2, 3)) for _ in rows])
            got = [x for i, j in sd.meetings(key, doc, marks) for x in zip(i.tolist(), j.tolist())]
            want = {(i, j) for i in range(n) for j in range(i + 1, n)
                    if key[i] == key[j] and doc[i] != doc[j] and (marks[j] > 0 or marks[i] >= 2)}
            assert len(got) == len(want) and set(got) == want
        sd.MEETINGS = before
    kept = 0
    for _ in range(600):  # a run around two seeds, edited: nothing that segments gives is ruled out
        base = [rng.randrange(10 ** 6) for _ in range(rng.randrange(40, 90))]
        texts = []
        for _ in range(2):
            t, rate = list(base), rng.choice((0.02, 0.1, 0.2))
            for k in range(len(t)):
                if rng.random() < rate:
                    t[k] = rng.randrange(10 ** 6)
            texts.append([rng.randrange(10 ** 6) for _ in range(rng.randrange(0, 30))] + t + [rng.randrange(10 ** 6) for _ in range(rng.randrange(0, 30))])
        a, b = (np.array(t, np.uint64) for t in texts)
        seeds = [(i, j) for i in range(len(a) - sd.K) for j in range(len(b) - sd.K) if (a[i:i + sd.K] == b[j:j + sd.K]).all()]
        if len(seeds) < 2:
            continue
        p, q = (list(x) for x in zip(seeds[0], seeds[-1]))
        if p[1] - p[0] < 12 or p[1] - p[0] > sd.FAR:
            continue
        sides = [sd.beside(h, np.array([x[0]]), np.array([x[1] + sd.K]), 50) for h, x in ((a, p), (b, q))]
        left, right = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
        may = sd.may_share(np.array([p[1] - p[0], q[1] - q[0]]), left, right, np.array([0]), np.array([1]), 50, 0.8)
        if sd.segments(a, b, [x for x, _ in seeds], [y for _, y in seeds], 50, 0.8):
            kept += 1
            assert may[0]
        x, y = (np.array([rng.randrange(1, 3) for _ in range(50)], np.uint8) for _ in range(2))
        assert sd.grown(x[None], y[None])[0][0] >= sd.grow(x == y)
    assert kept > 50


def test_only_uncovered_runs_of_an_earlier_text_ask_and_all_that_are_equal_offer():
    rng = random.Random(47)
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    asked = 0
    for _ in range(12):
        lines = [[rng.randrange(10 ** 6) for _ in range(rng.randrange(20, 90))] for _ in range(6)]
        texts = [np.array([w for _ in range(rng.randrange(0, 5)) for w in rng.choice(lines)], np.uint64) for _ in range(9)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        value, text, place = sd.minimisers(np.concatenate(texts), first)
        value &= ~np.uint64(1)
        places = {}
        for v, t, p in zip(value.tolist(), text.tolist(), place.tolist()):
            places.setdefault(v, []).append((t, p))
        seeded = [[(p, np.uint64(v).astype(np.int64), x[0][0] < t) for v, x in places.items() if len(x) > 1 for u, p in x if u == t] for t in range(9)]
        spans = [[(a, min(a + rng.randrange(50, 120), len(t))) for a in (rng.randrange(len(t) - 50) for _ in range(rng.randrange(3)))]
                 if len(t) > 60 else [] for t in texts]
        columns = [lists([[s[k] for s in rows] for rows in seeded], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.bool_()))]
        got = {(t, p): (v, on) for t, p, v, on in zip(*(x.tolist() for x in sd.asking(
            *columns, lists([[x for s in mine for x in s] for mine in spans], pa.int32()), 50)))}
        late = {(t, s[0]) for t, rows in enumerate(seeded) for s in rows if s[2]}
        assert all(k in late for k, (_, on) in got.items() if on)
        windows = {}
        for t, x in enumerate(texts):
            for w in range(len(x) - 49):
                windows.setdefault(x[w:w + 50].tobytes(), []).append((t, w))
        for same in windows.values():
            for t, w in same:
                if t == same[0][0] or any(a <= w and w + 50 <= b for a, b in spans[t]):
                    continue
                mine = [p for p in range(w, w + sd.WINDOW) if got.get((t, p), (0, False))[1]]
                assert any(all(got.get((u, y + p - w), (None,))[0] == got[t, p][0] for u, y in same) for p in mine)
                asked += 1
        whole = lists([[0, len(t)] for t in texts], pa.int32())
        for t, p, _, on in zip(*(x.tolist() for x in sd.asking(*columns, whole, 50))):
            assert not on or p > len(texts[t]) - 50
    assert asked > 300
