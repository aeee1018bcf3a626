import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import chat, mixing, queries

PIECES = ["\\", "### ", "</turn>", " ", "\n", "###", "Assistant: ", "user", ": ", "x", "é", "</turn", "\\\\", " </turn>\n", "turn>"]
ROLES = ["user", "assistant", "", "Sys\n: ", "a_b", "UP"]


def test_every_turn_reads_back():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text
    for _ in range(500):
        turns = [(rng.choice(ROLES), "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(6))]
        shown = "".join(chat.format_turn(*t)[0] for t in turns)
        assert [x[:2] for x in chat.parse(shown)] == turns


def test_plain_turns_stay_as_they_are():
    assert chat.format_turn("user", "hello") == ("### User: hello </turn>\n", 0)
    with pytest.raises(ValueError):
        chat.parse("no turn")


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        sha, loss = hashlib.sha256(), ""
        for _, _, role, text in turns:
            sha.update(f"{role or ''}\n{text or ''}\n".encode())
            loss += (text or "") if role == "assistant" else ""
        out[conv] = (len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_round_trip(spark):
    rows = [(1, 1, "assistant", "b </turn>\n"), (1, 0, "user", None), (2, 0, "user", "\\### x"), (3, 5, "assistant", "é" * 4000), (3, 7, None, "q"),
            (3, 6, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, shown string")
    got = chat.read_back(chat.format_conversations(df))
    assert {r["conv_id"]: tuple(r)[1:5] for r in got.collect()} == want(rows)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    got = queries.op7_chat_formatting(spark, "/root/testdata/sf0.001").collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want(rows)


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    sizes = [10, 1000, 0, 500, 7]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_splitting_tree_deals_every_draw_once():
    quotas = np.array([1000, 3, 0, 77])
    whole = list(mixing.deal(quotas, 13, 5, 0, 13))
    drawn = Counter((k, j) for _, which, start, own in whole for k, lo, n in zip(which, start, own) for j in range(lo, lo + n))
    assert drawn == Counter((k, j) for k, n in enumerate(quotas) for j in range(n))
    sizes = [int(own.sum()) for _, _, _, own in whole]
    assert [s for s, *_ in whole] == list(range(13)) and max(sizes) - min(sizes) <= 2
    parts = [x for lo in (0, 5, 6) for x in mixing.deal(quotas, 13, 5, lo, {0: 5, 5: 6, 6: 13}[lo])]  # tasks of their own
    assert [(s, *(v.tolist() for v in x)) for s, *x in parts] == [(s, *(v.tolist() for v in x)) for s, *x in whole]


def test_fill_comes_as_near_as_any_choice():
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.randrange(0, 30) for _ in range(rng.randrange(0, 9))]
        room, exact = rng.randrange(0, 120), rng.choice([1 << 16, 60])
        got = mixing.fill(sizes, room, exact)
        assert len(set(got)) == len(got) and sum(sizes[k] for k in got) <= room
        if room <= exact:
            sums = {0}
            for x in sizes:
                sums |= {y + x for y in sums}
            assert sum(sizes[k] for k in got) == max(y for y in sums if y <= room)


def rows_of(n):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "b", "é", "Z", None])) for k in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (n + 2, "big " * 3000, "big"), (n + 3, "x y", "small"), (n + 3, "x y", "small")]


def test_mix_against_its_contract(spark):
    rows = rows_of(1500)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, k int")
    got = mixing.mix_table(df)
    again = sorted(map(tuple, mixing.mix_table(df.repartition(7)).collect()))
    out = got.collect()
    assert sorted(map(tuple, out)) == again
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, size(t)) for i, t, _ in rows)
    totals = Counter()
    for i, t, s in rows:
        totals[s] += size(t)
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    want_targets = dict(zip(names, mixing.targets([totals[s] for s in names])))
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(want_targets[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in ("a", "b", "é", "Z", None):
        assert abs(taken[s] - want_targets[s]) <= 1
    assert mixing.mix_table(df.limit(0)).count() == 0


def test_draws_match_the_takes(spark):
    rows = rows_of(800)
    df = spark.createDataFrame([(*r, k, "z") for k, r in enumerate(rows)], "doc_id long, text string, source string, shard int, h string")
    copies = Counter()
    for r in mixing.mix_table(df).collect():
        copies[r["doc_id"]] += r["copies"]
    draws = mixing.mix_draws(df).collect()
    assert Counter(r["row"]["doc_id"] for r in draws) == +copies
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    shards = mixed.rdd.mapPartitions(lambda part: [[r["doc_id"] for r in part]]).collect()
    order = {}
    for r in sorted(draws, key=lambda r: (r["shard"], r["at"])):
        order.setdefault(r["shard"], []).append(r["row"]["doc_id"])
    for ids in order.values():  # each shard's documents stand together and in its own order
        assert any(ids == part[k:k + len(ids)] for part in shards for k in range(len(part) - len(ids) + 1))


def test_query_over_the_whole_table(spark):
    """Targets by plain water filling, and how near the takes come."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):  # the level at which all shares together are 150 %
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in names) < 1.5 * sum(total.values()) else (low, level)
    got = queries.op10_mixing(spark, sf).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted(size.items())
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(min(2 * total[s], low * weight[s]), rel=1e-6)
        assert r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - min(2 * total[s], low * weight[s])) <= 1 + max(size[i] for i, _, x in rows if x == s) * 0.01
