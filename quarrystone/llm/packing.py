"""Packing token sequences: a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` ids.  Only the histogram of
piece lengths reaches the driver: at most ``capacity`` numbers, however many
documents there are.  Multiplicative weights solve the covering program over
patterns, pricing each new pattern with a knapsack dynamic program; patterns
are rounded down to whole numbers and what is left is packed best fit first,
still by lengths, not by pieces.  Each piece then finds its sequence from its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import materialise
from quarrystone.llm.tokens import encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
FULL = 1 << 40  # sequences of one full piece are numbered from here on, by task and place


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of lengths with the highest price (unbounded knapsack); prices[s] is of length s."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    sizes = np.flatnonzero(prices)
    value = prices[sizes]
    for c in range(int(sizes[0]) if len(sizes) else capacity + 1, capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        gain = best[c - sizes[:k]] + value[:k]
        j = int(gain.argmax())
        if gain[j] > best[c - 1]:
            best[c], took[c] = gain[j], sizes[j]
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if took[c] == 0:
            c -= 1
        else:
            pattern[int(took[c])] += 1
            c -= int(took[c])
    return float(best[capacity]), dict(pattern)


def fractional(counts: np.ndarray, capacity: int, rounds: int, eta: float = 12.0) -> dict[tuple, float]:
    """Patterns and how often each is used, by multiplicative weights on the lengths' demands."""
    sizes = np.flatnonzero(counts)
    need = counts[sizes].astype(float)
    bound = float((sizes * need).sum()) / capacity
    step = bound / rounds
    covered = np.zeros(len(sizes))
    used: dict[tuple, float] = defaultdict(float)
    at = {int(s): k for k, s in enumerate(sizes)}
    for t in range(rounds):
        # lengths behind the even pace weigh more; a length's volume is its base weight
        weight = np.exp(np.clip(-eta * (covered / need - t / rounds), -40, 40))
        prices = np.zeros(capacity + 1)
        prices[sizes] = weight * sizes
        _, pattern = best_pattern(prices, capacity)
        # a step never covers a length further than its whole demand
        size = min([step, *(need[at[s]] / n for s, n in pattern.items())])
        used[tuple(sorted(pattern.items()))] += size
        for s, n in pattern.items():
            covered[at[s]] += n * size
    return used


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over a histogram: patterns with how many sequences have each."""
    free: dict[int, list[list]] = defaultdict(list)
    open_rooms: set[int] = set()
    for s in np.flatnonzero(left)[::-1].tolist():
        n = int(left[s])
        while n:
            room = min((r for r in open_rooms if r >= s), default=None)
            if room is None:
                fit = capacity // s
                whole, rest = divmod(n, fit)
                for times, each in ((whole, fit), (1 if rest else 0, rest)):
                    if times:
                        free[capacity - each * s].append([{s: each}, times])
                        open_rooms.add(capacity - each * s)
                break
            pattern, times = free[room].pop()
            each = room // s
            use = min(times, n // each)
            if use == 0:
                each, use = n, 1
            if times > use:
                free[room].append([pattern, times - use])
            if not free[room]:
                open_rooms.discard(room)
            grown = dict(pattern)
            grown[s] = grown.get(s, 0) + each
            free[room - each * s].append([grown, use])
            open_rooms.add(room - each * s)
            n -= use * each
    return [(p, t) for groups in free.values() for p, t in groups]


def plan(counts: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole multiplicities that hold every piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    left[capacity:] = 0
    out = []
    if left.any():
        used = fractional(left, capacity, rounds)
        for pattern, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            whole = min([int(times), *(int(left[s]) // n for s, n in pattern)])
            if whole > 0:
                out.append((dict(pattern), whole))
                for s, n in pattern:
                    left[s] -= n * whole
        out += best_fit(left, capacity)
    return out


def lookup(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length, ranges of ranks: first sequence, pieces of it in one, place of the first."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for s, n in sorted(pattern.items(), reverse=True):
            rows.append((s, ranks[s], n, sequence, offset))
            ranks[s] += n * times
            offset += n * s
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"]).sort_values(
        ["length", "rank"], ignore_index=True)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, numbered within their task and length; written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for keys, ids, at in encoded(batches, tokenizer_path):
            raw = memoryview(ids.astype("<u4").tobytes())
            out = []
            for key, a, b in zip(keys, at[:-1].tolist(), at[1:].tolist()):
                n = b - a
                first = n if n <= capacity else (n % capacity or capacity)
                lo, hi, piece = 0, first, 0
                while lo < n:
                    size = hi - lo
                    out.append((key, piece, lo, size, zlib.crc32(raw[4 * (a + lo):4 * (a + hi)]), part, int(seen[size])))
                    seen[size] += 1
                    lo, hi, piece = hi, hi + capacity, piece + 1
            columns = zip(*out)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return materialise(rows.mapInArrow(cut, PIECES), "pieces")


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, rounds: int = 200,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece, the end id alone.  A document longer
    than ``capacity`` is cut so that its first piece takes the odd length.
    Rows that repeat an id are packed as rows of their own.  An empty table
    gives no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col, text_col)
    by_part = materialise(pieces.where(F.col("length") < capacity).groupBy("part", "length").agg(
        F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # below capacity rows
        counts[row["length"]] = row["n"]
    table = lookup(plan(counts, capacity, rounds))
    first = {c: table[c].to_numpy() for c in table.columns}
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "part", "nth",
        (F.col("base") + F.col("nth")).alias("rank"))

    def place(frames):
        # lengths and ranks as one ascending number: ranks stay far below 2**48
        keys = (first["length"].astype(np.int64) << 48) + first["rank"].astype(np.int64) if len(table) else np.empty(0, np.int64)
        for f in frames:
            length = f["length"].to_numpy()
            whole = length == capacity
            rank = f["rank"].fillna(0).to_numpy(np.int64)
            sequence = FULL + (f["part"].to_numpy(np.int64) << 36) + f["nth"].to_numpy(np.int64)
            offset = np.zeros(len(f), np.int64)
            short = np.flatnonzero(~whole)
            if len(short):
                k = np.searchsorted(keys, (length[short] << 48) + rank[short], side="right") - 1
                past = rank[short] - first["rank"][k]
                sequence[short] = first["sequence"][k] + past // first["each"][k]
                offset[short] = first["offset"][k] + past % first["each"][k] * length[short]
            yield f[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, PACKED)
