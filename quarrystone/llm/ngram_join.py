"""N-gram Jaccard join with partition-and-enumerate signatures.

A document is its set of distinct word shingles.  Sets are put in bands of
sizes so narrow that linked sets lie in one band or in neighbours, and in a
band linked sets differ in at most ``k`` shingles.  The shingle domain is
partitioned into ``k // 2 + 1`` parts of three subparts each: some part then
holds at most one difference, and the two of its subparts without it are equal
in both sets.  Each choice of two subparts of each part is one signature, so
linked sets always share one and no link is lost.

Sets with a common signature meet around its smallest document.  Small sketches,
the numbers of shingles by hash class, are compared before any set moves: their
distance is never more than the sets', so what they rule out can't link.  First
each set is verified against the one document that it shares most signatures
with, which joins nearly all copies to classes.  What is left are possible pairs
across classes: their components are taken over all gatherings, so that a set
moves once however many signatures it shares, and verified exactly.  Large
gatherings and components are cut into blocks, and every two blocks are a task
of their own.  Tasks return spanning forests, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import tokens
from quarrystone.llm.common import connected_components, drop_shuffles, materialise
from quarrystone.llm.tokens import slices, utf8

BLOCK_SETS = 512
BLOCK_SHINGLES = 1_500_000
SEEN = 500_000  # sets that a task remembers so as to sign copies once
SIZE_LIMIT = 1 << 31  # more shingles than any text has: a value is below 2 GB
_U = np.uint64
SPREAD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
TWO_OF_FIVE = np.array([[k in pair for pair in combinations(range(5), 2)] for k in range(5)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text (A-Z lower-cased), in a row, and where each text's begin."""
    n = len(offsets) - 1
    data, offsets = _LOWER[data[offsets[0]:offsets[-1]]], offsets - offsets[0]
    nothing = np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    if len(data) == 0:
        return nothing
    white = _WHITE[data]
    new = ~white
    new[1:] &= white[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    new[begin] = ~white[begin]
    starts = np.flatnonzero(new)
    if not len(starts):
        return nothing
    # a word with the white space after it; a word that ends its text has none of the next text's letters
    ends = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.strip()) for w in coded.dictionary.to_pylist()), np.uint64,
                        len(coded.dictionary))
    return table[coded.indices.to_numpy()], np.searchsorted(starts, offsets)


def rolled_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from each word on (the last ones are not whole)."""
    rolled = h.copy()
    for j in range(1, min(width, len(h))):
        rolled[:len(h) - j] = mix(rolled[:len(h) - j] * _U(0x9E3779B97F4A7C15) + h[j:])
    return rolled


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, in a row, and where each text's begin."""
    n = len(offsets) - 1
    h, first = word_hashes(data, offsets)
    if not len(h):
        return h, np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    out, at = [], np.zeros(n + 1, np.int64)
    rolled = rolled_hashes(h, width)
    for d in range(n):
        c = int(counts[d])
        if c == 0:
            mine = rolled[:0]
        elif c < width:  # the whole sequence as one
            one = h[first[d]:first[d] + 1]
            for j in range(1, c):
                one = mix(one * _U(0x9E3779B97F4A7C15) + h[first[d] + j:first[d] + j + 1])
            mine = mix(one + _U(c))
        else:
            mine = np.sort(rolled[first[d]:first[d] + c - width + 1])
            mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
        out.append(mine)
        at[d + 1] = at[d] + len(mine)
    return np.concatenate(out), at


class Bands:
    """Size bands for a similarity ``part / whole`` and the partitions that each needs."""

    def __init__(self, part: int, whole: int, largest: int = SIZE_LIMIT):
        lows, highs = [], []
        low = 1
        while low <= largest:
            high = low * whole // part
            lows.append(low)
            highs.append(high)
            low = high + 1
        highs.append(low * whole // part)
        self.lows = np.array(lows)
        self.k = np.array(highs) * 2 * (whole - part) // (whole + part)
        self.parts = self.k // 2 + 1

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1


def signatures(shingles: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets and the set that each is of.

    Every set signs for its own band and for the next larger one.  A band whose
    sets may not differ at all needs none: equal sets are one class already.

    Two subparts without a shingle would match too many sets.  The third then
    differs in at most one shingle, so it signs whole and without each of its
    shingles.  If that leaves nothing either, the next part decides: parts stand
    in a ring and hold fewer than two differences on average, so from some good
    part on every run of ``n`` parts has at most ``2n - 1`` of them.  The part
    after it has at most three, and two of its five subparts none.
    """
    sizes = np.diff(at)
    sets, sigs = [], []
    low, high = shingles & _U(0xFFFFFFFF), shingles >> _U(32)
    value = mix(shingles + _U(0x1234567))
    left, right = value & _U((1 << 40) - 1), value >> _U(40)
    worth = left * SPREAD[0] + right * SPREAD[1]
    left, right = left.astype(np.float64), right.astype(np.float64)
    sub = ((low * _U(3)) >> _U(32)).astype(np.int64)

    def totals(cell: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """Sums of ``worth`` by cell, from exact sums of integers below 2**53."""
        return (np.bincount(cell, left[which], n).astype(np.uint64) * SPREAD[0]
                + np.bincount(cell, right[which], n).astype(np.uint64) * SPREAD[1])

    def sign(content: np.ndarray, salt: np.ndarray, owner: np.ndarray) -> None:
        sigs.append(mix(content ^ mix(salt)).ravel())
        sets.append(owner)

    for up in (0, 1):
        band = bands.band(np.maximum(sizes, 1)) + up
        parts = np.where((sizes > 0) & (bands.k[band] > 0), bands.parts[band], 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        n = int(base[-1])
        if n == 0:
            continue
        mine = np.flatnonzero(np.repeat(parts > 0, sizes))
        doc = np.repeat(np.arange(len(sizes)), sizes)[mine]
        part = ((high[mine] * parts[doc].astype(np.uint64)) >> _U(32)).astype(np.int64) + base[doc]
        cell = part * 3 + sub[mine]
        total, held = totals(cell, mine, 3 * n), np.bincount(cell, minlength=3 * n)
        whole, full = total.reshape(-1, 3).sum(axis=1, dtype=np.uint64), held.reshape(-1, 3).sum(axis=1)
        owner = np.repeat(np.arange(len(sizes)), parts)
        salt = (band[owner].astype(np.uint64) << _U(36)) + (np.arange(n) - base[owner]).astype(np.uint64) * _U(16)
        # 0 to 2: the two subparts but this one; 3 to 5: this one, the others being empty; 6 on: two of the next part's five
        alone = held == np.repeat(full, 3)
        two = np.flatnonzero(~alone)
        sign(whole[two // 3] - total[two], salt[two // 3] + (two % 3).astype(np.uint64), owner[two // 3])
        third = np.flatnonzero(alone & (held > 0))
        sign(total[third], salt[third // 3] + (third % 3 + 3).astype(np.uint64), owner[third // 3])
        less = np.flatnonzero((alone & (held > 1))[cell])
        c = cell[less]
        sign(total[c] - worth[mine[less]], salt[c // 3] + (c % 3 + 3).astype(np.uint64), owner[c // 3])
        rare = np.flatnonzero(full < 2)
        if not len(rare):
            continue
        start = base[owner[rare]]
        row = np.full(n, -1)
        row[start + (rare - start + 1) % parts[owner[rare]]] = np.arange(len(rare))
        near = np.flatnonzero(row[part] >= 0)
        fifth = row[part[near]] * 5 + ((right[mine[near]].astype(np.int64) * 5) >> 24)
        content = totals(fifth, mine[near], 5 * len(rare)).reshape(-1, 5) @ TWO_OF_FIVE
        sign(content, salt[rare][:, None] + np.arange(6, 16, dtype=np.uint64), np.repeat(owner[rare], 10))
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(sets)


def set_ids(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of mixed shingles."""
    out = []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ _U(salt)), dtype=np.uint64)])
        out.append(total[at[1:]] - total[at[:-1]])
    return out[0], out[1]


def sketches(shingles: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Counts of shingles by hash class, a byte each; two to four shingles a class, so that unrelated sets differ in most."""
    sizes = np.diff(at)
    classes = 1 << np.maximum(5, np.floor(np.log2(np.maximum(sizes, 1) / 2 + 1e-9)).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(classes)])
    value = mix(shingles ^ _U(0x3C6EF372FE94F82B)).astype(np.int64)
    cell = np.repeat(base[:-1], sizes) + (value & np.repeat(classes - 1, sizes))
    raw = np.minimum(np.bincount(cell, minlength=base[-1]), 255).astype(np.uint8).tobytes()
    return [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def propagate(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the smallest index of its component."""
    m = len(near)
    label = np.arange(m)
    while True:
        low = np.where(near, label[None, :], m).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def folded(held: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of equal width; wider ones are folded."""
    return np.stack([np.frombuffer(h, np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int32) for h in held])


def _equal_runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return [0, *edges.tolist()], [*edges.tolist(), len(values)]


def possible_parts(sizes: np.ndarray, held: list[bytes], classes: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Components of the pairs of different classes that their sketches do not rule out.

    Linked sets differ in at most (whole - part) / (whole + part) of their sizes' sum.
    Each pair is compared in the width of its smaller set: a small set must not
    blur the larger ones of its gathering, which then would all seem near.
    """
    m = len(held)
    order = np.argsort(sizes, kind="stable")
    held, sizes, classes = [held[k] for k in order], sizes[order], classes[order]
    last = np.searchsorted(sizes * part, sizes * whole, side="right")
    widths = np.minimum.accumulate(np.array([len(h) for h in held])[::-1])[::-1]
    near = np.eye(m, dtype=bool)
    for lo, hi in zip(*_equal_runs(widths)):
        grid = folded(held[lo:int(last[hi - 1])], int(widths[lo]))
        for i in range(lo, hi):
            j = slice(i + 1, int(last[i]))
            if j.start < j.stop:
                apart = np.abs(grid[j.start - lo:j.stop - lo] - grid[i - lo]).sum(axis=1)
                near[i, j] = (apart * (whole + part) <= (sizes[i] + sizes[j]) * (whole - part)) & (classes[j] != classes[i])
    label = propagate(near | near.T)
    out = np.empty(m, np.int64)
    out[order] = order[label]
    return out


def linked_parts(sets: list[np.ndarray], part: int, whole: int, columns: int = 4096) -> np.ndarray:
    """For each set the smallest index of its component by exact links (blocked products of 0/1 rows)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    distinct, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = count > 1
    rank = np.cumsum(useful) - 1
    keep = useful[code]
    owner, code = owner[keep], rank[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((m, m), np.float64)
    for lo in range(0, int(useful.sum()), columns):
        a, b = np.searchsorted(code, [lo, lo + columns])
        grid = np.zeros((m, min(columns, int(useful.sum()) - lo)), np.float32)
        grid[owner[a:b], code[a:b] - lo] = 1
        common += grid @ grid.T
    near = whole * common >= part * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(near, True)
    return propagate(near)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _parts(batches, width: int):
    tokens.forget()  # workers are used again: their cache of pieces makes room for sets
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        keys = batch.column(0)
        for lo, hi in slices(offsets, 1 << 20):
            yield keys.slice(lo, hi - lo), *shingle_sets(data, offsets[lo:hi + 1], width)


def _placed(rows: DataFrame, wanted: DataFrame, task: str, width: int) -> DataFrame:
    """The sets of ids in ``wanted(a, tasks)`` for each of their ``tasks``; a text moves once.

    The wanted grow with the input: they are never broadcast, at any size.
    """

    def hash_sets(batches):
        for batch in batches:
            done = 0
            for keys, shingles, at in _parts([batch], width):
                raw = memoryview(shingles.tobytes())
                found = pa.array([raw[8 * x:8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, found, batch.column(2).slice(done, len(keys))],
                                                 names=["a", "shingles", "tasks"])
                done += len(keys)

    kind = wanted.schema["tasks"].dataType.simpleString()
    held = rows.join(wanted.hint("merge"), rows["doc_id"] == wanted["a"]).select("doc_id", "text", "tasks").mapInArrow(
        hash_sets, f"a long, shingles binary, tasks {kind}")
    return held.select("a", "shingles", F.explode("tasks").alias("t")).select("a", "shingles", "t.*").repartition(*task.split())


def _best_links(rows: DataFrame, star: DataFrame, own: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Links ``u, v`` of each set to the document that it shares most signatures with, where sketches allow it."""

    def possible(batches):
        for batch in batches:
            sizes = np.stack([batch.column(c).to_numpy() for c in (3, 5)], axis=1)
            keep = sizes.max(axis=1) * part <= sizes.min(axis=1) * whole
            one, two = batch.column(4).to_pylist(), batch.column(6).to_pylist()
            for k in np.flatnonzero(keep).tolist():
                x, y = folded([one[k], two[k]], min(len(one[k]), len(two[k])))
                keep[k] = np.abs(x - y).sum() * (whole + part) <= sizes[k].sum() * (whole - part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in range(3)], names=["hub", "a", "n"])

    lead = own.select(F.col("a").alias("id"), F.col("n_shingles").alias("hub_shingles"), F.col("sketch").alias("hub_sketch"))
    pairs = star.join(own, "a").join(lead, star["hub"] == lead["id"]).select(
        "hub", "a", "n", "n_shingles", "sketch", "hub_shingles", "hub_sketch").mapInArrow(possible, "hub long, a long, n long")
    best = materialise(pairs.groupBy("a").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")), "best")
    blocks = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("blocks"))
    asked = best.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("a"), "blocks").alias("block"), "a")
    asked = asked.withColumn("lead", F.lit(False)).unionByName(
        asked.select("hub", "block", F.col("hub").alias("a")).distinct().withColumn("lead", F.lit(True)))
    wanted = asked.groupBy("a").agg(F.collect_list(F.struct("hub", "block", "lead")).alias("tasks"))

    def verify(batches):
        """A hub's sets come first in its task and are held; the others pass by."""
        key, leads = None, []
        for batch in batches:
            out = []
            for hub, block, lead, a, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, block) != key:
                    key, leads = (hub, block), []
                mine = np.frombuffer(raw, np.uint64)
                if lead:
                    leads.append(mine)
                    continue
                for s in leads:
                    common = len(np.intersect1d(s, mine, assume_unique=True))
                    if whole * common >= part * (len(s) + len(mine) - common):
                        out.append((a, hub))
                        break
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return _placed(rows, wanted, "hub block", width).sortWithinPartitions("hub", "block", F.desc("lead")).select(
        "hub", "block", "lead", "a", "shingles").mapInArrow(verify, "u long, v long").distinct()


def _tiled(members: DataFrame, key: str) -> DataFrame:
    """``key, lo, hi`` added to members ``(key, a, n_shingles, ...)``: each two blocks of a large group are one tile."""
    weight = members.groupBy(key).agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return members.join(weight, key).withColumn("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("b", "o")).withColumn(
        "hi", F.greatest("b", "o")).drop("blocks", "b", "o")


def _links_between(rows: DataFrame, star: DataFrame, own: DataFrame, found: DataFrame, width: int, part: int,
                   whole: int) -> DataFrame:
    """A spanning forest ``u, v`` of links within the possible pairs across classes."""
    around = star.select("hub", "a").unionByName(star.select("hub", F.col("hub").alias("a")).distinct())
    around = materialise(around.join(found, around["a"] == found["node"], "left").select(
        "hub", "a", F.coalesce("component", "a").alias("class")), "around")
    mixed = around.groupBy("hub").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("hub")
    tiles = _tiled(around.join(mixed, "hub", "left_semi").join(own.select("a", "n_shingles"), "a"), "hub")

    def sift(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "size"])
        label = possible_parts(frame["size"].to_numpy(np.int64), list(frame["sketch"]), frame["class"].to_numpy(), part, whole)
        ids = frame["a"].to_numpy(np.int64)
        other = ids[label] != ids
        return pd.DataFrame({"u": ids[other], "v": ids[label[other]]})

    sketched = own.select("a", F.col("n_shingles").alias("size"), "sketch")
    left = tiles.drop("n_shingles").distinct().join(sketched, "a").groupBy("hub", "lo", "hi").applyInPandas(sift, "u long, v long")
    groups = connected_components(left.distinct()).select(F.col("node").alias("a"), F.col("component").alias("group"))
    weighed = groups.join(own.groupBy("a").agg(F.sum("n_shingles").alias("n_shingles")), "a")
    wanted = _tiled(weighed, "group").groupBy("a").agg(F.collect_list(F.struct("group", "lo", "hi")).alias("tasks"))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("a")
        ids = frame["a"].to_numpy(np.int64)
        label = linked_parts([np.frombuffer(x, np.uint64) for x in frame["shingles"]], part, whole)
        other = ids[label] != ids
        return pd.DataFrame({"u": ids[other], "v": ids[label[other]]})

    return materialise(_placed(rows, wanted, "group lo hi", width).groupBy("group", "lo", "hi").applyInPandas(
        verify, "u long, v long"), "between")


def jaccard_components(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two documents link when ``whole * |A & B| >= part * |A | B|``.  A text of
    fewer than ``width`` words is one shingle; a text without words has none
    and links with nothing, and neither does a row with a null id, whose
    component is null.  Rows that repeat an id are one document with all their
    links.  An empty table gives no rows.
    """
    rows = _columns(docs, id_col, text_col)
    bands = Bands(part, whole)

    def profile(batches):
        for keys, shingles, at in _parts(batches, width):
            one, two = set_ids(shingles, at)
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(np.diff(at)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.array(sketches(shingles, at), pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    sets = materialise(rows.mapInArrow(profile, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "sets")
    usable = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(usable.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    member = materialise(usable.join(classes, ["n_shingles", "h1", "h2"]).select(
        "doc_id", "rep", "n_shingles").distinct(), "member")

    def sign(batches):
        seen: set[tuple[int, int]] = set()
        for keys, shingles, at in _parts(batches, width):
            sigs, owner = signatures(shingles, at, bands)
            one, two = set_ids(shingles, at)
            fresh = np.ones(len(one), bool)
            for d, key in enumerate(zip(one.tolist(), two.tolist())):
                fresh[d] = key not in seen  # a copy in this task has signed already
                if len(seen) < SEEN:
                    seen.add(key)
            keep = fresh[owner]
            ids = keys.cast(pa.int64()).take(pa.array(owner[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(sigs[keep].view(np.int64)), ids], names=["sig", "doc_id"])

    signed = rows.where("doc_id IS NOT NULL").mapInArrow(sign, "sig long, doc_id long")

    def gather(batches):
        """Sorted signatures, read as a stream: every later document of one meets its first; ``n`` signatures in common."""
        sig, hub = None, None
        for batch in batches:
            s, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(s):
                continue
            new = np.concatenate([[sig is None or s[0] != sig], s[1:] != s[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            hubs = np.where(begin >= 0, d[np.maximum(begin, 0)], hub if hub is not None else 0)
            sig, hub = s[-1], hubs[-1]
            other = hubs != d
            pairs, n = np.unique(np.stack([hubs[other], d[other]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)],
                                             names=["hub", "doc_id", "n"])

    met = signed.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(
        gather, "hub long, doc_id long, n long").groupBy("hub", "doc_id").agg(F.sum("n").alias("n"))
    names = member.select(F.col("doc_id").alias("id"), "rep")
    star = met.join(names, met["doc_id"] == names["id"]).select("hub", F.col("rep").alias("a"), "n")
    star = star.join(names, star["hub"] == names["id"]).select(F.col("rep").alias("hub"), "a", "n").where("hub <> a")
    star = materialise(star.groupBy("hub", "a").agg(F.sum("n").alias("n")), "star")
    drop_shuffles(star.sparkSession)  # of all signatures
    own = materialise(usable.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), "n_shingles", "sketch"), "own")
    # an id with several sets joins their classes
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v <> w")
    several = materialise(member.join(twice, "doc_id").select(F.col("rep").alias("u"), "v"), "several")
    first = materialise(_best_links(rows, star, own, width, part, whole).unionByName(several), "links")
    drop_shuffles(first.sparkSession)  # of texts and sets
    found = connected_components(first)
    rest = _links_between(rows, star, own, found, width, part, whole)
    drop_shuffles(rest.sparkSession)
    if not rest.isEmpty():
        found = connected_components(first.unionByName(rest))
    parts = member.join(found, member["rep"] == found["node"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"))
    return sets.select("doc_id", "n_shingles").join(materialise(parts, "parts"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (a null id stays)."""
    gone = jaccard_components(docs, width, part, whole, id_col, text_col).where(
        "component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
