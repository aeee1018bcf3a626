"""Substring dedup by collinear chaining.

Each text is read and hashed once; from then on a word is its 32-bit hash.
Texts are sampled into word k-mers, the smallest hash of every window, so two
equal runs of ``K + WINDOW - 1`` words always share a seed.  Each seed's
occurrences are joined to its first one, which gives anchors between two
documents, as many as occurrences and never all pairs.  Anchors of two
documents are chained in order with a gap cost, the best predecessor found in a
Fenwick tree, and each chain is aligned word by word to find the fuzzy passage
that the two share.  A chain over words that differ too much is cut there.

The seeds of one passage may first occur in different documents, and then no
chain holds the whole of it.  Where repeated seeds follow each other so closely
that a passage of the least length may lie there, and no passage found covers
it, the hashes of all runs of that length are joined to their first occurrence.

What is then still in no passage may be a passage with changed words.  There the
seeds meet by twos, as far apart as those of a passage are: a document meets
every earlier one that has the same two, and every later one where nothing is
linked yet, but only where the words before the one seed and after the other let a
passage of the least length stand, as one byte a word tells without loss.  So a
common line brings no pairs of the documents that share nothing beside it.  The free
seeds that two such documents share are chained and aligned as before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import drop_shuffles, materialise
from quarrystone.llm.ngram_join import mix, rolled_hashes, word_hashes
from quarrystone.llm.tokens import slices, utf8

K, WINDOW = 8, 16
WEIGHT, GAP_COST = 8.0, 0.125  # a seed's worth, and the cost of a word of either gap
TOGETHER = 256  # requests that share one copy of a text
MARGIN = 48  # words beside a chain that the alignment may grow into
FAR = 128  # words that two seeds may be apart to stand for a passage
MEETINGS = 1 << 16  # places of two seeds compared at once
CROSSED = 8  # places in one document by those in the other up to which a seed's all meet
MOST = np.uint64(2 ** 64 - 1)


def minimisers(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the sampled k-mers, the text and the word where each begins."""
    kmers = rolled_hashes(h, K) if len(h) else h
    counts = np.maximum(np.diff(first) - K + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return np.empty(0, np.uint64), text, text
    place = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    value = kmers[first[:-1][text] + place]
    # texts stand WINDOW places apart, so that no window sees two of them
    at = np.arange(len(text)) + (text + 1) * WINDOW
    line = np.full(len(text) + (len(counts) + 2) * WINDOW, MOST)
    line[at] = value
    low, step = line, 1
    while step < WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    high, step = low, 1  # the largest of the minima of all windows around a place
    while step < WINDOW:
        high = np.maximum(high[:-step], high[step:])
        step *= 2
    # low[j] is of places j to j + WINDOW - 1, and high[i] of windows i to i + WINDOW - 1
    taken = high[at - WINDOW + 1] == value
    return value[taken], text[taken], place[taken]


def with_ranks(value: np.ndarray, text: np.ndarray, place: np.ndarray):
    """The seeds, and once more those that a text has several times, by how often it came before.

    All occurrences meet the first one anywhere; by rank, the n-th meets an
    n-th one, so repeated runs inside two texts are chained side by side too.
    Seeds of a rank are odd, the others even.
    """
    order = np.lexsort((place, value, text))
    v, t = value[order], text[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])]) if len(v) else np.empty(0, bool)
    rank = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    more = order[rank > 0]
    again = mix(value[more] + rank[rank > 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([value & ~np.uint64(1), again | np.uint64(1)]), np.concatenate([text, text[more]]), np.concatenate([place, place[more]])


class Fenwick:
    """Largest value so far among ranks up to one, with who has it."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, rank: int, item: tuple[float, int]) -> None:
        while rank < len(self.best):
            if item > self.best[rank]:
                self.best[rank] = item
            rank += rank & -rank

    def top(self, rank: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while rank:
            if self.best[rank] > out:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(p: list[int], q: list[int]) -> list[list[int]]:
    """Indexes of the anchors of each chain; anchors come sorted by ``p``, then ``q``.

    score(i) = WEIGHT + max(0, score(j) - GAP_COST * (dp + dq)) over earlier
    anchors j with smaller p and q; the cost is a difference of sums, so a
    prefix maximum of score + GAP_COST * (p + q) finds the best j.
    """
    n = len(p)
    ranks = {v: k for k, v in enumerate(sorted(set(q)), 1)}
    tree, score, back = Fenwick(len(ranks)), [0.0] * n, [-1] * n
    k = 0
    while k < n:
        same = k
        while same < n and p[same] == p[k]:
            value, j = tree.top(ranks[q[same]] - 1)
            gain = value - GAP_COST * (p[same] + q[same])
            score[same] = WEIGHT + max(0.0, gain)
            back[same] = j if gain > 0 else -1
            same += 1
        for i in range(k, same):
            tree.put(ranks[q[i]], (score[i] + GAP_COST * (p[i] + q[i]), i))
        k = same
    used, out = [False] * n, []
    for i in sorted(range(n), key=score.__getitem__, reverse=True):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest common subsequence of two short runs."""
    if len(a) == len(b):
        straight = int((a == b).sum())
        if straight == len(a):
            return straight
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = row = (1 << len(a)) - 1  # a 0 bit is where a row of the usual table steps up
    for y in b.tolist():
        if at := places.get(y):
            up = row & at
            row = ((row + up) | (row - up)) & full
    return len(a) - row.bit_count()


def grow(same: np.ndarray, allowed: int = 3) -> int:
    """How far a run of equal words goes on, over single differences that are followed by more equal words."""
    best = score = top = 0
    for k, equal in enumerate(same.tolist(), 1):
        score += 1 if equal else -2
        if score > top:
            best, top = k, score
        if score < top - 2 * allowed:
            break
    return best


def align(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int]) -> tuple[int, int, int, int, int]:
    """(start, end) in both runs and matched words of a chain with places in the runs."""
    before = min(p[0], q[0])
    left = grow((a[p[0] - before:p[0]] == b[q[0] - before:q[0]])[::-1])
    last_p, last_q = p[-1], q[-1]
    after = min(len(a) - last_p, len(b) - last_q)
    right = grow(a[last_p:last_p + after] == b[last_q:last_q + after])
    matched = int((a[p[0] - left:p[0]] == b[q[0] - left:q[0]]).sum()) + int((a[last_p:last_p + right] == b[last_q:last_q + right]).sum())
    for i in range(len(p) - 1):
        matched += common_words(a[p[i]:p[i + 1]], b[q[i]:q[i + 1]])
    return p[0] - left, last_p + right, q[0] - left, last_q + right, matched


def runs(same: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal and of different words on one diagonal, as (words in a, words in b, matched)."""
    edges = np.flatnonzero(np.diff(same, prepend=~same[:1])) if len(same) else np.empty(0, np.int64)
    return [(n, n, n if same[at] else 0) for at, n in zip(edges.tolist(), np.diff(edges, append=len(same)).tolist())]


def steps(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], least: float) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Where a chain begins and its steps through both runs; a badly matched gap is cut where its ends stop matching."""
    before = min(p[0], q[0])
    left = grow((a[p[0] - before:p[0]] == b[q[0] - before:q[0]])[::-1])
    out = runs(a[p[0] - left:p[0]] == b[q[0] - left:q[0]])
    for x, x1, y, y1 in zip(p, p[1:], q, q[1:]):
        m = common_words(a[x:x1], b[y:y1])
        if m >= least * max(x1 - x, y1 - y):
            out.append((x1 - x, y1 - y, m))
            continue
        n = min(x1 - x, y1 - y)
        head = grow(a[x:x + n] == b[y:y + n])
        n -= head
        tail = grow((a[x1 - n:x1] == b[y1 - n:y1])[::-1])
        out += runs(a[x:x + head] == b[y:y + head])
        rest = common_words(a[x + head:x1 - tail], b[y + head:y1 - tail])
        out.append((x1 - x - head - tail, y1 - y - head - tail, rest))
        out += runs(a[x1 - tail:x1] == b[y1 - tail:y1])
    after = min(len(a) - p[-1], len(b) - q[-1])
    same = a[p[-1]:p[-1] + after] == b[q[-1]:q[-1] + after]
    return p[0] - left, q[0] - left, out + runs(same[:grow(same)])


def maximal(score: list[float]) -> list[tuple[int, int]]:
    """Maximal scoring runs of steps (Ruzzo and Tompa): no longer run around one scores more, and none holds a better one."""
    found: list[tuple[int, int, float, float]] = []  # start, end, total before it, total with it
    total = 0.0
    for k, x in enumerate(score):
        start, before, total = k, total, total + x
        if x <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, k + 1, before, total))
    return [(s, e) for s, e, _, _ in found]


def segments(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], min_words: int,
             least: float) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain, each like the result of ``align``: the whole chain, or else its parts that match well.

    Parts are runs of maximal segments of matched minus mismatched words, chosen
    to be long enough, to have the identity and to match the most words in all.
    """
    whole = align(a, b, p, q)
    a0, a1, b0, b1, matched = whole
    if min(a1 - a0, b1 - b0) < min_words:
        return []
    if matched >= least * max(a1 - a0, b1 - b0):
        return [whole]
    a0, b0, path = steps(a, b, p, q, least)
    at = np.cumsum([(a0, b0, 0), *path], axis=0)
    parts = maximal([m - least * max(x, y) for x, y, m in path])
    if not parts:
        return []
    begin, end = at[[s for s, _ in parts]], at[[e for _, e in parts]]
    best, back = np.zeros(len(parts) + 1, np.int64), [-1] * (len(parts) + 1)
    for j in range(len(parts)):
        size = end[j] - begin[:j + 1]
        fits = (size[:, :2].min(axis=1) >= min_words) & (size[:, 2] >= least * size[:, :2].max(axis=1))
        gain = np.where(fits, best[:j + 1] + size[:, 2], -1)
        i = int(gain.argmax())
        best[j + 1] = max(best[j], gain[i])
        back[j + 1] = i if gain[i] > best[j] else -1
    out, j = [], len(parts)
    while j:
        i = back[j]
        if i >= 0:
            (x0, y0, m0), (x1, y1, m1) = begin[i].tolist(), end[j - 1].tolist()
            out.append((x0, x1, y0, y1, m1 - m0))
        j = i if i >= 0 else j - 1
    return out[::-1]


def _hashed(batches):
    """The 32-bit hashes of each text's words, in order, as bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in slices(offsets, 4 << 20):
            h, first = word_hashes(data, offsets[lo:hi + 1])
            words = pa.Array.from_buffers(pa.binary(), hi - lo, [
                None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(h.astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), words], names=["doc_id", "words"])


def _words(batch):
    data, offsets = utf8(batch.column(1))
    for lo, hi in slices(offsets, 2 << 20):
        yield lo, hi - lo, data[offsets[lo]:offsets[hi]].view(np.uint32).astype(np.uint64), (offsets[lo:hi + 1] - offsets[lo]) // 4


def wide_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from each word on, for all places where they are whole, from runs of doubled widths."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out, done, step, here = None, 0, 1, h
    while done < width:
        if width & step:
            part = here[done:done + n]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += step
        here = mix(here[:-step] * np.uint64(0x9E3779B97F4A7C15) + here[step:]) if len(here) > step else here[:0]
        step *= 2
    return out


def runs_of(lows: np.ndarray, highs: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where the next begins at most ``apart`` after all before it."""
    order = np.argsort(lows, kind="stable")
    lows, far = lows[order], np.maximum.accumulate(highs[order])
    new = np.concatenate([[True], lows[1:] > far[:-1] + apart])
    return lows[new], far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lows) - 1]])]


def open_windows(n: int, seeded: np.ndarray, covered: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``width`` words may repeat in a text of ``n`` words, and which of them no passage covers.

    Every window of seeds in a repeated run has a repeated seed, so these are at
    most ``WINDOW`` apart there and reach nearly to its ends.
    """
    some, hidden = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
    if len(seeded):
        for lo, hi in zip(*runs_of(seeded[:, 0], seeded[:, 1], WINDOW)):
            lo, hi = max(lo - WINDOW + 1, 0), min(hi + K + WINDOW - 1, n) - width
            if hi >= lo:
                some[lo] += 1
                some[hi + 1] -= 1
    for lo, hi in covered.tolist():
        if min(hi, n) - width >= lo:
            hidden[lo] += 1
            hidden[min(hi, n) - width + 1] -= 1
    places = np.flatnonzero(np.cumsum(some) > 0)
    return places, np.cumsum(hidden)[places] == 0


def asking(seeded: pa.ListArray, seeds: pa.ListArray, late: pa.ListArray, covered: pa.ListArray, width: int):
    """Seeds (text, place, seed) where runs of ``width`` words may repeat, and whether one that asks may begin with each.

    A run that an earlier text has holds no seed but late ones, which are first
    in an earlier text; it asks where no passage covers it.  The first ``WINDOW``
    places of a run hold a sampled seed, so equal runs have one at the same place
    in them.  A text's end is not known, so a few may be too many.
    """
    def flat(lists):
        offsets = lists.offsets.to_numpy()
        return lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], np.diff(offsets)

    (place, counts), (value, _), (after, _), (edges, sides) = map(flat, (seeded, seeds, late, covered))
    far = np.int64(1) << 33  # texts stand so far apart
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((place, text))
    text, place, value, after = text[order], place[order], value[order], after[order]
    at = text * far + place

    def first_in(at):
        """Places of runs that may repeat around these seeds, each the first in them, from and to."""
        lows, highs = runs_of(at, at, WINDOW)
        run = np.searchsorted(lows, at, side="right") - 1
        return (np.maximum(at - WINDOW + 1, np.maximum(lows[run] - WINDOW + 1, at // far * far)),
                np.minimum(at, highs[run] + K + WINDOW - 1 - width))

    asks = np.zeros(len(at), bool)
    if not len(at):
        return text, place, value, asks
    begin, end = first_in(at)
    dense = end >= begin
    if after.any():
        begin, end = first_in(at[after])
        open_ = end >= begin
        owner = np.repeat(np.arange(len(sides)), sides)[::2] * far
        hide, until = owner + edges[::2], owner + edges[1::2] - width
        hide, until = hide[until >= hide], until[until >= hide]
        if len(hide):
            hide, until = runs_of(hide, until, 1)
            k = np.searchsorted(hide, begin, side="right") - 1
            open_ &= (k < 0) | (until[np.maximum(k, 0)] < end)
        asks[after] = open_
    return text[dense], place[dense], value[dense], asks[dense]


def inside(places: np.ndarray, size: int, spans: list[list[int]]) -> np.ndarray:
    """Whether ``size`` words from each place on lie in spans that touch."""
    if not spans:
        return np.zeros(len(places), bool)
    low, high = np.array(spans, np.int64).T
    low, high = runs_of(low, high, 0)
    at = np.searchsorted(low, places, side="right") - 1
    return (at >= 0) & (places + size <= high[at])


def ends(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places are not amid a run that repeats itself: the same seed so far before as after."""
    order = np.lexsort((place, seed))
    s, p = seed[order], place[order]
    amid = np.zeros(len(s), bool)
    amid[1:-1] = (s[:-2] == s[2:]) & (p[1:-1] - p[:-2] == p[2:] - p[1:-1]) & (p[1:-1] - p[:-2] <= WINDOW)
    out = np.ones(len(s), bool)
    out[order[amid]] = False
    return out


def twos(seed: np.ndarray, place: np.ndarray, text: np.ndarray, least: int):
    """Hashes of two seeds of a text ``least`` to ``FAR`` words apart, with the indexes of both, a distance in the list at a time."""
    step = 1
    while step < len(place):
        gap = place[step:] - place[:-step]
        near = (text[step:] == text[:-step]) & (gap <= FAR)
        if not near.any():
            break
        at = np.flatnonzero(near & (gap >= least))
        yield mix(seed[at] * np.uint64(0x9E3779B97F4A7C15) + seed[at + step]), at, at + step
        step += 1


def two_seeds(seed: np.ndarray, place: np.ndarray, text: np.ndarray, least: int, marks: np.ndarray):
    """Hashes of two seeds of a text ``least`` to ``FAR`` words apart, once in a text, with the marks that both have in some place."""
    found = [once(key, text[i], marks[i] & marks[j]) for key, i, j in twos(seed, place, text, least)]
    return once(*map(np.concatenate, zip(*found))) if found else (seed[:0], text[:0], marks[:0])


def beside(h: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each of ``width`` words before places, nearest first, and from other places on; 0 is outside the text."""
    line = np.zeros(len(h) + 2 * width, np.uint8)
    line[width:width + len(h)] = 1 + h % np.uint64(255)
    steps = np.arange(width)
    top = len(line) - 1
    return line[np.clip(width + low[:, None] - 1 - steps, 0, top)], line[np.clip(width + high[:, None] + steps, 0, top)]


def grown(a: np.ndarray, b: np.ndarray, allowed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """At least what ``grow`` gives for words with these bytes, and whether it may go on behind them."""
    same = (a == b) & (a != 0)
    score = np.cumsum(np.where(same, 1, -2), axis=1, dtype=np.int16)
    top = np.maximum.accumulate(np.maximum(score, 0), axis=1)
    on = np.logical_and.accumulate(score >= top - 2 * allowed, axis=1)
    peak = (on & same & (score == top))[:, ::-1]
    return np.where(peak.any(axis=1), a.shape[1] - peak.argmax(axis=1), 0), on[:, -1]


def may_share(span: np.ndarray, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, min_words: int, least: float) -> np.ndarray:
    """Whether a passage can hold the same two seeds in places ``i`` and ``j`` as its first and last ones.

    Bytes that differ are different words, so none that ``segments`` gives is ruled out.
    """
    small, large = np.minimum(span[i], span[j]) + K, np.maximum(span[i], span[j]) + K
    before, more = grown(left[i], left[j])
    after, yet_more = grown(right[i], right[j])
    words = before + after + small
    return more | yet_more | ((words >= min_words) & (words >= least * (words + large - small)))


def meetings(key: np.ndarray, doc: np.ndarray, marks: np.ndarray):
    """Pairs of indexes with the same key, the second of the later document, where it is free or the first is in no link; rows come sorted."""
    at = np.arange(len(key))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.maximum.accumulate(np.where(new, at, 0))
    end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    # a free place and all before it; a place in no link and those after it that are not free
    for who, lo, n in ((at, begin, np.where(marks > 0, at - begin, 0)), (at, at + 1, np.where(marks >= 2, end - at - 1, 0))):
        total = np.cumsum(n)
        k = 0
        while k < len(at):
            top = max(int(np.searchsorted(total, (total[k - 1] if k else 0) + MEETINGS, side="right")), k + 1)
            mine = np.repeat(who[k:top], n[k:top])
            other = np.arange(len(mine)) - np.repeat(np.cumsum(n[k:top]) - n[k:top], n[k:top]) + np.repeat(lo[k:top], n[k:top])
            i, j = np.minimum(mine, other), np.maximum(mine, other)
            good = (doc[i] != doc[j]) & ((mine == j) | (marks[j] == 0))
            if good.any():
                yield i[good], j[good]
            k = top


def once(key: np.ndarray, text: np.ndarray, marks: np.ndarray):
    """Each key of a text once, with all marks that it has there."""
    order = np.lexsort((key, text))
    key, text, marks = key[order], text[order], marks[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else order
    return key[new], text[new], np.bitwise_or.reduceat(marks, new) if len(new) else marks


def shared(seeds: list[int], places: list[int], other: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Sorted pairs of places of the same seed in two documents.

    Of a seed so often in both that ``CROSSED`` is passed, those of equal rank
    from either end meet, and all meet the first.
    """
    mine: dict[int, list[int]] = {}
    for x, p in zip(seeds, places):
        if x in other:
            mine.setdefault(x, []).append(p)
    out = set()
    for x, ps in mine.items():
        qs = other[x]
        if len(ps) * len(qs) <= CROSSED:
            out.update((p, q) for p in ps for q in qs)
        else:
            out.update(zip(ps, qs), zip(ps[::-1], qs[::-1]), ((p, qs[0]) for p in ps), ((ps[0], q) for q in qs))
    return sorted(out)


def cover(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The fewest of (start, end, source start) with the same words in all."""
    out, end, best = [], -1, None
    for row in sorted(found, key=lambda r: (r[0], -r[1])):
        if best is not None and row[0] > end:
            out.append(best)
            end, best = best[1], None
        if row[1] > (best[1] if best else end):
            if not out or row[0] > end:
                out.append(row)
                end = row[1]
            else:
                best = row
    return out + ([best] if best else [])


CHAINED = {"doc": pa.int64(), "source": pa.int64(), "ps": pa.list_(pa.int32()), "qs": pa.list_(pa.int32()),
           "seeds": pa.list_(pa.int64()), "late": pa.bool_()}
CUT = ["doc", "source", "side", "p0", "q0", "lo", "places", "words"]
PASSAGES = ("doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, "
            "matched_words long, identity double")


def repeated_passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Passages of at least ``min_words`` words that a document shares with the first one that has their seeds.

    Exact runs of that length that these leave out, because their seeds begin in
    different documents, follow with the first document that has the whole run.
    Then come the passages in what is still left that hold two seeds which both
    documents have, with every earlier document: these differ in words from each other.

    Columns: ``doc_id, start_word, end_word, source_doc_id, source_start,
    source_end, matched_words, identity``; ends are exclusive, words are runs
    outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, and identity is matched words
    over the longer side.  The source keeps its passage: it has the smaller id.
    Null and short texts have no passage, rows with a null id are left out, and
    rows that repeat an id are one document, not compared with each other.  An
    empty table gives no rows.
    """
    rows = materialise(docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        _hashed, "doc_id long, words binary"), "words")

    def seeds(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, n, h, first in _words(batch):
                value, text, place = with_ranks(*minimisers(h, first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), ids.slice(lo, n).take(pa.array(text)), pa.array(place.astype(np.int32)),
                     pa.array(np.ones(len(place), bool))], names=["seed", "doc_id", "p", "asks"])

    def join(batches):
        """Sorted seeds as a stream: each occurrence, but in a run that is covered already, meets the first occurrence.

        The first one meets itself once there is another.
        """
        seed = hub = hub_p = None
        alone = False  # whether the row before is the first of its seed
        for batch in batches:
            s, d, p, asks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(s):
                continue
            new = np.concatenate([[seed is None or s[0] != seed], s[1:] != s[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            source = np.where(begin >= 0, d[np.maximum(begin, 0)], hub or 0)
            q = np.where(begin >= 0, p[np.maximum(begin, 0)], hub_p or 0).astype(np.int32)
            seed, hub, hub_p = s[-1], int(source[-1]), int(q[-1])
            other = asks & ((source != d) | (q != p))
            second = ~new & np.concatenate([[alone], new[:-1]])
            alone = bool(new[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[other], y[second]])) for x, y in ((s, s), (d, source), (source, source), (p, q), (q, q))],
                names=["seed", "doc_id", "source", "p", "q"])

    def met(df):
        return df.repartition("seed").sortWithinPartitions("seed", "doc_id", "p").mapInArrow(
            join, "seed long, doc_id long, source long, p int, q int")

    anchors = met(rows.mapInArrow(seeds, "seed long, doc_id long, p int, asks boolean"))
    reach = min_words - K - 2 * (WINDOW - 1)  # an exact passage that long has seeds at least so far apart

    def chain(batches):
        """Chains of each two documents, and a document's repeated seeds in a row without a source; rows come sorted."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            d, s = cols[:2]
            if not len(d):
                continue
            last = len(d) - int(((d != d[-1]) | (s != s[-1]))[::-1].argmax()) if ((d != d[-1]) | (s != s[-1])).any() else 0
            if held and (last or held[0][0][0] != d[0] or held[0][1][0] != s[0]):
                whole = [np.concatenate(c) for c in zip(*held, [c[:last] for c in cols])]
                held = []
                yield from of_groups(*whole)
            elif last:
                yield from of_groups(*(c[:last] for c in cols))
            held.append([c[last:] for c in cols])
        if held:
            yield from of_groups(*(np.concatenate(c) for c in zip(*held)))

    def of_groups(d, s, p, q, seed):
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
        even = np.flatnonzero(seed & 1 == 0)
        if len(even):
            group = np.cumsum(new)[even]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            at, to = even[first], pa.array(np.append(first, len(even)).astype(np.int32))
            # late ones are first in another document
            yield _listed(d[at], None, pa.ListArray.from_arrays(to, pa.array(p[even])), None,
                          pa.ListArray.from_arrays(to, pa.array(seed[even])), d[at] != s[at])
        some = (d != s) & (new | np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
        d, s, p, q = (x[some] for x in (d, s, p, q))
        if not len(d):
            return
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(d))
        dp, dq = np.diff(p, prepend=p[:1]), np.diff(q, prepend=q[:1])
        # anchors that all follow the one before, at less than they are worth: one chain is the best one of each
        plain = np.logical_and.reduceat(new | ((dp > 0) & (dq > 0) & (GAP_COST * (dp + dq) < WEIGHT)), first)
        far = p[ends - 1] - p[first] >= reach
        chosen = plain & far
        if chosen.any():
            rows = np.repeat(chosen, ends - first)
            to = pa.array(np.concatenate([[0], np.cumsum((ends - first)[chosen])]).astype(np.int32))
            yield _listed(d[first[chosen]], s[first[chosen]], *(pa.ListArray.from_arrays(to, pa.array(x[rows])) for x in (p, q)), None, None)
        out = []
        for lo, hi in zip(first[far & ~plain].tolist(), ends[far & ~plain].tolist()):
            ps, qs = p[lo:hi].tolist(), q[lo:hi].tolist()
            for c in chains(ps, qs):
                if ps[c[-1]] - ps[c[0]] >= reach:
                    out.append((int(d[lo]), int(s[lo]), [ps[i] for i in c], [qs[i] for i in c], None, None))
        if out:
            yield _chained(out)

    def _listed(*columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t)
                                           for c, t in zip(columns, CHAINED.values())], names=list(CHAINED))

    def _chained(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CHAINED.values())], names=list(CHAINED))

    chained = materialise(anchors.repartition("doc_id", "source").sortWithinPartitions("doc_id", "source", "p", "q").select(
        "doc_id", "source", "p", "q", "seed").mapInArrow(
        chain, "doc long, source long, ps array<int>, qs array<int>, seeds array<long>, late boolean"), "chains")
    drop_shuffles(docs.sparkSession)

    def requests(found):
        def ask(who: str, side: int, places: str):
            lo = F.greatest(F.element_at(places, 1) - MARGIN, F.lit(0))
            return found.select(
                F.col(who).alias("want"), "doc", "source", F.lit(side).alias("side"), F.element_at("ps", 1).alias("p0"),
                F.element_at("qs", 1).alias("q0"), lo.alias("lo"), (F.element_at(places, -1) + K + MARGIN).alias("hi"),
                F.col(places).alias("places"))

        asked = ask("doc", 0, "ps").unionByName(ask("source", 1, "qs")).repartition("want")
        # a text moves once for every TOGETHER of its requests
        order = Window.partitionBy("want").orderBy("doc", "source", "p0", "q0", "side")
        asks = asked.withColumn("group", F.floor((F.row_number().over(order) - 1) / TOGETHER)).groupBy("want", "group").agg(
            F.collect_list(F.struct("doc", "source", "side", "p0", "q0", "lo", "hi", "places")).alias("asks"))
        return rows.join(asks.hint("merge"), rows["doc_id"] == asks["want"]).select("words", "asks")

    def cut(batches):
        """The asked parts of each text as 32-bit word hashes."""
        for batch in batches:
            parts, n = [], 0
            for words, several in zip(*batch.columns):
                h = np.frombuffer(words.as_buffer(), np.uint32)
                held = several.values.flatten()
                low, high = held[5].to_pylist(), held[6].to_pylist()
                out = pa.array([h[x:y].tobytes() for x, y in zip(low, high)], pa.binary())
                parts.append(pa.RecordBatch.from_arrays([*held[:6], held[7], out], names=CUT))
                n += len(out)
                if n >= 1000:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, n = [], 0
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    def _passages(out):
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64()] * 7 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=[x.split()[0] for x in PASSAGES.split(", ")])

    def verify(batches):
        first = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                doc, source, p0, q0, side, lo, places, words = row
                if side == 0:
                    first = row
                    continue
                if first is None or first[:4] != row[:4]:
                    continue  # an id whose rows differ: its other text has no such place
                a, b = np.frombuffer(first[7], np.uint32), np.frombuffer(words, np.uint32)
                p, q = [x - first[5] for x in first[6]], [x - lo for x in places]
                if p[-1] + K > len(a) or q[-1] + K > len(b):
                    continue
                for a0, a1, b0, b1, matched in segments(a, b, p, q, min_words, min_identity):
                    out.append((doc, a0 + first[5], a1 + first[5], source, b0 + lo, b1 + lo, matched,
                                matched / max(a1 - a0, b1 - b0)))
            yield _passages(out)

    def verified(found):
        parts = requests(found).mapInArrow(
            cut, "doc long, source long, side int, p0 int, q0 int, lo int, places array<int>, words binary")
        return parts.repartition("doc", "source").sortWithinPartitions("doc", "source", "p0", "q0", "side").select(
            "doc", "source", "p0", "q0", "side", "lo", "places", "words").mapInArrow(verify, PASSAGES)

    passages = materialise(verified(chained.where("source IS NOT NULL")), "passages")
    drop_shuffles(docs.sparkSession)

    def spans_of(df, doc: str, start: str, end: str):
        return df.select(F.col(doc).alias("doc"), F.array(F.col(start).cast("int"), F.col(end).cast("int")).alias("ps")).distinct()

    repeated = chained.where("source IS NULL")
    def listed(column, seeded=True):
        return F.flatten(F.collect_list(F.when(F.col("seeded") == seeded, column)))

    spans = repeated.select("doc", F.lit(True).alias("seeded"), "ps", "seeds", "late").unionByName(
        spans_of(passages, "doc_id", "start_word", "end_word").select("doc", F.lit(False).alias("seeded"), "ps"),
        allowMissingColumns=True).groupBy("doc").agg(
        listed(F.col("ps")).alias("seeded"), listed(F.col("seeds")).alias("seeds"),
        listed(F.array_repeat("late", F.size("ps"))).alias("late"), listed(F.col("ps"), False).alias("covered"))

    def asked(batches):
        """Seeds where runs may repeat; those of a run that no passage covers ask."""
        for batch in batches:
            doc, place, value, asks = asking(*batch.columns[1:], min_words)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), batch.column(0).take(pa.array(doc)), pa.array(place), pa.array(~asks)], names=["seed", "doc", "p", "still"])

    def live(batches):
        """Of seeds as a stream, in each those first that ask: the seeds that any asks for."""
        seed, on = None, False
        for batch in batches:
            s, still = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3))
            if not len(s):
                continue
            new = np.concatenate([[seed is None or s[0] != seed], s[1:] != s[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            wanted = np.where(begin >= 0, ~still[np.maximum(begin, 0)], on)
            seed, on = s[-1], bool(wanted[-1])
            wanted &= ~(new & np.concatenate([new[1:], [False]]))  # in one place only
            yield batch.filter(pa.array(wanted))

    lively = spans.mapInArrow(asked, "seed long, doc long, p int, still boolean").repartition("seed").sortWithinPartitions(
        "seed", "still").mapInArrow(live, "seed long, doc long, p int, still boolean").groupBy("doc").agg(
        F.array_sort(F.collect_set("p")).alias("live"))
    wanted = spans.join(lively.hint("merge"), "doc")
    spanned = rows.join(wanted.hint("merge"), rows["doc_id"] == wanted["doc"]).select(
        "doc_id", "words", "seeded", "covered", "live")

    def windows(batches):
        for batch in batches:
            ids, marked, hidden, needed = (batch.column(c).to_pylist() for c in (0, 2, 3, 4))
            for lo, n, h, first in _words(batch):
                for k in range(n):
                    mine = h[first[k]:first[k + 1]]
                    places, asks = open_windows(len(mine), np.repeat(np.array(marked[lo + k], np.int64), 2).reshape(-1, 2),
                                                np.array(hidden[lo + k], np.int64).reshape(-1, 2), min_words)
                    seeds = np.array([*needed[lo + k], np.iinfo(np.int32).max])
                    held = seeds[np.searchsorted(seeds, places)] < places + WINDOW
                    places, asks = places[held], asks[held]
                    if len(places):
                        value = wide_hashes(mine, min_words)[places]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(value.view(np.int64)), pa.array(np.full(len(places), ids[lo + k])),
                             pa.array(places.astype(np.int32)), pa.array(asks)], names=["seed", "doc_id", "p", "asks"])

    def exact(batches):
        """Runs of windows on one diagonal, which come sorted, as passages."""
        key, held = None, []

        def finish():
            for start, end, q in cover(held):
                yield key[0], start, end, key[1], q, q + end - start, end - start, 1.0

        for batch in batches:
            out = []
            for d, s, p, q in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, s) != key:
                    out += finish()
                    key, held = (d, s), []
                if held and held[-1][2] - held[-1][0] == q - p and p <= held[-1][1] - min_words + 1:
                    held[-1] = (held[-1][0], p + min_words, held[-1][2])
                else:
                    held.append((p, p + min_words, q))
            if out:
                yield _passages(out)
        if held:
            yield _passages(list(finish()))

    whole = met(spanned.mapInArrow(windows, "seed long, doc_id long, p int, asks boolean")).where("doc_id <> source")
    plain = materialise(passages.unionByName(whole.repartition("doc_id", "source").sortWithinPartitions(
        "doc_id", "source", F.col("q") - F.col("p"), "p").select("doc_id", "source", "p", "q").mapInArrow(exact, PASSAGES)), "passages")
    drop_shuffles(docs.sparkSession)

    # seeds outside all passages, as 1: it repeats nothing so far, 2: nor is it repeated
    def left(batches):
        key, linked = None, ([], [])
        for batch in batches:
            out = []
            for doc, kind, ps, seeds in zip(*(c.to_pylist() for c in batch.columns)):
                if doc != key:
                    key, linked = doc, ([], [])
                if kind < 2:
                    linked[kind].append(ps)
                    continue
                place, value = np.array(ps, np.int32), np.array(seeds, np.int64)
                few = ends(value, place)
                place, value = place[few], value[few]
                free = ~inside(place, K, linked[0])
                alone = free & ~inside(place, K, linked[1])
                asks = alone | (free & (kind == 3))
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array(value), pa.array(np.full(len(place), doc)), pa.array(place), pa.array(~asks),
                     pa.array(free + 2 * alone.astype(np.int32), pa.int32())], names=["seed", "doc", "p", "still", "marks"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def sketch(batches):
        """A document's seeds in one row."""
        held, key = [], None

        def row():
            return [key, *map(list, zip(*held))]

        def _rows(out):
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc", "seeds", "ps", "marks"])

        for batch in batches:
            out = []
            for doc, *seed in zip(*(c.to_pylist() for c in batch.columns)):
                if doc != key:
                    if len(held) > 1:
                        out.append(row())
                    held, key = [], doc
                held.append(seed)
            if out:
                yield _rows(out)
        if len(held) > 1:
            yield _rows([row()])

    def around(batches):
        """The places of two seeds, with the bytes of the words beside them."""
        for batch in batches:
            ids, *lists = (batch.column(c).to_pylist() for c in (0, 2, 3, 4))
            for lo, n, h, first in _words(batch):
                out = []
                for k in range(n):
                    seeds, ps, marks = (np.array(x[lo + k], t) for x, t in zip(lists, (np.int64, np.int32, np.int32)))
                    found = list(twos(seeds.view(np.uint64), ps, np.zeros(len(ps), np.int8), max(reach, 1)))
                    if not found:
                        continue
                    key, i, j = map(np.concatenate, zip(*found))
                    before, after = beside(h[first[k]:first[k + 1]], ps[i], ps[j] + K, min_words)
                    out.append(pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(key), ids[lo + k])), pa.array(marks[i] & marks[j]),
                         pa.array(ps[j] - ps[i]), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (before, after))],
                        names=["key", "doc", "marks", "span", "before", "after"]))
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def meet(batches):
        """Documents, each with those that it may share a passage with around the same two seeds; rows come sorted."""
        held = None

        def pairs(table):
            key, doc, marks, span = (table.column(c).to_numpy() for c in range(4))
            left, right = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, min_words) for c in (4, 5))
            for i, j in meetings(key, doc, marks):
                good = may_share(span, left, right, i, j, min_words, min_identity)
                if good.any():
                    later, earlier = doc[j[good]], doc[i[good]]
                    order = np.lexsort((earlier, later))
                    later, earlier = later[order], earlier[order]
                    new = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(later[new]), pa.ListArray.from_arrays(pa.array(np.append(new, len(later)).astype(np.int32)), pa.array(earlier))],
                        names=["doc", "sources"])

        for batch in batches:
            if not len(batch):
                continue
            here = pa.Table.from_batches([batch])
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if held is None:
                held = here.slice(last)
                whole = here.slice(0, last)
            elif last == 0 and held.column(0)[0].as_py() == key[0]:
                held = pa.concat_tables([held, here])
                continue
            else:
                held, whole = here.slice(last), pa.concat_tables([held, here.slice(0, last)])
            if len(whole):
                yield from pairs(whole)
        if held is not None:
            yield from pairs(held)

    def apart(batches):
        """Each pair once; rows come sorted by document."""
        key, held = None, []

        def row():
            found = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], names=["doc", "source"])

        for batch in batches:
            out = []
            lists = batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                if doc != key:
                    if held:
                        out.append(row())
                    key, held = doc, []
                held.append(lists[k].values.to_numpy())
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield row()

    def again(batches):
        """Chains of the seeds of two documents that are in no passage yet."""
        key, other, unlinked = None, {}, set()
        for batch in batches:
            out = []
            for k, (doc, source, a, p, m) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if source != key:
                    key, other = source, {}
                    b, q, n = (c[k].as_py() for c in batch.columns[5:])
                    for x, y in zip(b, q):
                        other.setdefault(x, []).append(y)
                    unlinked = {y for y, mark in zip(q, n) if mark & 2}
                free = {x for x, mark in zip(p, m) if mark & 1}
                pairs = [(x, y) for x, y in shared(a, p, other) if x in free or y in unlinked]
                if not pairs or pairs[-1][0] - pairs[0][0] < reach:
                    continue
                for c in chains([x for x, _ in pairs], [y for _, y in pairs]):
                    if pairs[c[-1]][0] - pairs[c[0]][0] >= reach:
                        ps, qs = zip(*(pairs[i] for i in c))
                        out.append((doc, source, ps, qs, None, None))
            if out:
                yield _chained(out)

    known = spans_of(plain, "doc_id", "start_word", "end_word").withColumn("kind", F.lit(0)).unionByName(
        spans_of(plain, "source_doc_id", "source_start", "source_end").withColumn("kind", F.lit(1)))
    states = known.select("doc", "kind", "ps", F.lit(None).cast("array<long>").alias("seeds")).unionByName(
        repeated.select("doc", F.when(F.col("late"), 3).otherwise(2).alias("kind"), "ps", "seeds")).repartition(
        "doc").sortWithinPartitions("doc", "kind").mapInArrow(left, "seed long, doc long, p int, still boolean, marks int")
    sketches = materialise(states.repartition("seed").sortWithinPartitions("seed", "still", "doc", "p").mapInArrow(
        live, "seed long, doc long, p int, still boolean, marks int").repartition("doc").sortWithinPartitions("doc", "p").select(
        "doc", "seed", "p", "marks").mapInArrow(sketch, "doc long, seeds array<long>, ps array<int>, marks array<int>"), "sketches")
    drop_shuffles(docs.sparkSession)
    close = rows.join(sketches.hint("merge"), rows["doc_id"] == sketches["doc"]).select("doc", "words", "seeds", "ps", "marks").mapInArrow(
        around, "key long, doc long, marks int, span int, before binary, after binary").repartition("key").sortWithinPartitions(
        "key", "doc").mapInArrow(meet, "doc long, sources array<long>").repartition("doc").sortWithinPartitions("doc").mapInArrow(
        apart, "doc long, source long")
    theirs = sketches.toDF("source", "b", "q", "n")
    chained = materialise(close.join(sketches.toDF("doc", "a", "p", "m"), "doc").join(theirs, "source").repartition(
        "source", "doc").sortWithinPartitions("source", "doc").select("doc", "source", "a", "p", "m", "b", "q", "n").mapInArrow(
        again, chained.schema), "chains")
    drop_shuffles(docs.sparkSession)
    old, new = plain.alias("old"), verified(chained).alias("new")
    more = new.join(old, (F.col("old.doc_id") == F.col("new.doc_id")) & (F.col("old.source_doc_id") == F.col("new.source_doc_id"))
                    & F.expr("old.start_word <= new.start_word AND new.end_word <= old.end_word"), "left_anti")
    return plain.unionByName(more)
