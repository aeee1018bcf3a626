"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature at a time; what they add is
kept in one table per feature, and for a few pairs in a grid of two features.
A score is a sum of table entries, looked up for a whole batch at once.
Features are counts over the whole text; nothing else of a document is used.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.tokens import forget, utf8

MAX_TRAINING = 20_000
HELD_OUT = 5
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "digits", "symbols", "marks", "upper", "white", "high",
    "entropy", "log_lines", "line_length", "repeated_lines", "distinct_words", "top_word", "long_words",
    "short_words", "closed_lines", "commas", "stops", "brackets", "tail_symbols", "repeated_pairs", "first_upper",
    "capital_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars)] = 1
    return out


KINDS = np.stack([
    _table(bytes([*range(65, 91), *range(97, 123)])), _table(bytes(range(48, 58))), _table(b"#$%&*@^~=+_\\/|"),
    _table(b".,;:!?'\"-"), _table(bytes(range(65, 91))), _table(b" \t\n\x0b\x0c\r"), _table(bytes(range(128, 256))),
    _table(b","), _table(b".!?"), _table(b"()[]{}<>|"),
])


def features(text: bytes) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, digits, symbols, marks, upper, white, high, commas, stops, brackets = (KINDS @ counts).tolist()
    words = text.split()
    w = len(words)
    lines = [x for x in text.split(b"\n") if x]
    m = len(lines)
    lens = np.fromiter(map(len, words), np.int64, w)
    distinct = set(words)
    per_n, per_w, per_m = 1 / max(n, 1), 1 / max(w, 1), 1 / max(m, 1)
    share = counts[counts > 0] * per_n
    entropy = float(-(share * np.log2(share)).sum()) if n else 0.0
    codes = np.fromiter(map(hash, words), np.int64, w) if w else np.empty(0, np.int64)
    top = 0
    pairs = 0
    if w:
        ordered = np.sort(codes)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        top = int(np.diff(edges).max())
        if w > 1:
            two = np.sort(codes[:-1] * 3 + codes[1:])
            pairs = int((two[1:] == two[:-1]).sum())
    tails = sum(1 for x in words if not x[-1:].isalnum() and x[-1:] not in b".,;:!?'\")" and x[-1] < 128)
    capital = sum(map(bytes.istitle, words))
    return [
        np.log1p(n), np.log1p(w), (n - white) * per_w, letters * per_n, digits * per_n, symbols * per_n, marks * per_n,
        upper * per_n, white * per_n, high * per_n, entropy, np.log1p(m), n * per_m,
        1 - len(set(lines)) * per_m, len(distinct) * per_w, top * per_w, float((lens >= 15).sum()) * per_w,
        float((lens <= 3).sum()) * per_w, sum(x[-1:] in b".!?" for x in lines) * per_m, commas * per_w, stops * per_w,
        brackets * per_n, tails * per_w, pairs * per_w, float(text[:1].isupper()), capital * per_w,
    ]


class AdditiveModel:
    """Lookup tables over binned features, and over pairs of them."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 300, pair_rounds: int = 100, pairs: int = 8,
                 rate: float = 0.08, leaves: int = 4, smallest: int = 12, ridge: float = 4.0):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds = bins, pair_bins, rounds, pair_rounds
        self.n_pairs, self.rate, self.leaves, self.smallest, self.ridge = pairs, rate, leaves, smallest, ridge

    def _tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Steps of a shallow tree over ordered bins: the best cuts, one after another."""
        cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))
        cuts, gain_of = [0, len(g)], lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + self.ridge)
        for _ in range(self.leaves - 1):
            best = (1e-6, None)
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = np.arange(a + 1, b)
                at = at[(cn[at] - cn[a] >= self.smallest) & (cn[b] - cn[at] >= self.smallest)]
                if len(at):
                    gain = gain_of(a, at) + gain_of(at, b) - gain_of(a, b)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(at[k]))
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts[:-1], cuts[1:]):
            out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + self.ridge)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        k = x.shape[1]
        levels = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], levels)) for f in range(k)]
        code = self.codes(x)
        prior = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(prior / (1 - prior)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f in range(k):
                p = 1 / (1 + np.exp(-score))
                c, m = code[:, f], len(self.tables[f])
                if m < 2:
                    continue
                step = self.rate * self._tree(np.bincount(c, y - p, m), np.bincount(c, p * (1 - p), m),
                                              np.bincount(c, minlength=m))
                self.tables[f] += step
                score += step[c]
        # pairs: what a coarse grid explains of the rest
        coarse = self.coarse(code)
        p = 1 / (1 + np.exp(-score))
        m = self.pair_bins
        gains = []
        for a, b in combinations(range(k), 2):
            cell = coarse[:, a] * m + coarse[:, b]
            g, h = np.bincount(cell, y - p, m * m), np.bincount(cell, p * (1 - p), m * m)
            gains.append((float((g ** 2 / (h + 4 * self.ridge)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:self.n_pairs]]
        self.grids = [np.zeros(m * m) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for grid, (a, b) in zip(self.grids, self.pairs):
                p = 1 / (1 + np.exp(-score))
                cell = coarse[:, a] * m + coarse[:, b]
                g, h = np.bincount(cell, y - p, m * m), np.bincount(cell, p * (1 - p), m * m)
                n = np.bincount(cell, minlength=m * m)
                # a tree of depth two: one cut of the first feature, one of the second on each side
                g2, h2, n2 = (v.reshape(m, m) for v in (g, h, n))
                best, step = 0.0, None
                for cut in range(1, m):
                    made, gain = np.zeros((m, m)), 0.0
                    for rows in (slice(0, cut), slice(cut, m)):
                        side = self._halves(g2[rows].sum(0), h2[rows].sum(0), n2[rows].sum(0))
                        made[rows] = side
                        gain += float((2 * side * g2[rows].sum(0) - side ** 2 * h2[rows].sum(0)).sum())
                    if gain > best:
                        best, step = gain, made.ravel()
                if step is not None:
                    grid += self.rate * step
                    score += self.rate * step[cell]
        return self

    def _halves(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        kept, self.leaves = self.leaves, 2
        out = self._tree(g, h, n)
        self.leaves = kept
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def coarse(self, code: np.ndarray) -> np.ndarray:
        width = np.array([len(e) + 1 for e in self.edges])
        return code * self.pair_bins // np.maximum(width, 1)[None, :]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: table entries added for all rows at once."""
        code = self.codes(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[code[:, f]]
        coarse = self.coarse(code)
        for grid, (a, b) in zip(self.grids, self.pairs):
            total += grid[coarse[:, a] * self.pair_bins + coarse[:, b]]
        return 1 / (1 + np.exp(-total))


def held_out(id_col):
    """Rows that are never learned from: crc32 of the id as text leaves no rest by five."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(True))


def _matrix(column) -> np.ndarray:
    data, offsets = utf8(column)
    raw = memoryview(data)
    rows = [features(bytes(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_TRAINING) -> AdditiveModel:
    """A model from at most ``max_rows`` labelled documents, those with the smallest hashes of their id.

    A document labelled more than once takes the larger part; an even split and
    null labels are left out.  Without any labelled row the model knows nothing
    and scores one half.
    """
    import pyarrow as pa

    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(F.col(id_col)))
    votes = marks.groupBy(F.col(id_col).alias("_label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_mean"))
    sample = votes.where("_mean <> 0.5").orderBy(F.xxhash64("_label_id")).limit(max_rows).select(
        "_label_id", (F.col("_mean") > 0.5).cast("int").alias("_y"))
    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_label_id")).select("_id", "_text", "_y")

    def measure(batches):
        forget()
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = picked.select(F.col("_id").cast("long").alias("id"), "_text", F.col("_y").alias("y")).mapInArrow(
        measure, "id long, y int, x array<double>").toPandas()  # at most max_rows documents
    model = AdditiveModel()
    if not len(rows):
        model.edges = [np.empty(0)] * len(FEATURES)
        model.tables, model.base, model.pairs, model.grids = [np.zeros(1)] * len(FEATURES), 0.0, [], []
        return model
    rows = rows.sort_values(["id", "y"], kind="stable")
    return model.fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; null texts count as empty."""
    import pyarrow as pa

    def look_up(batches):
        forget()
        for b in batches:
            s = model.score(_matrix(b.column(1))) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array(
                (s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(look_up, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns and no shuffle."""
    def keep(frames):
        import pyarrow as pa

        forget()
        for f in frames:
            if f.num_rows:
                good = model.score(_matrix(f.column(f.schema.get_field_index(text_col)))) >= THRESHOLD
                yield f.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
