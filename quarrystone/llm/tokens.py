"""Token ids of whole texts, by the tokenizers library with a cache of pieces.

The library splits a text into pieces before it merges bytes, and a piece's
ids do not depend on its neighbours.  Places where a new piece must begin are
found for a whole batch at once by looking at neighbouring bytes; the stretches
between them are dictionary-encoded and looked up in arrays by their bytes.
Those not remembered go to the library, many as one text where a piece surely
begins between them; as each token is a known number of bytes, its ids fall
apart again.  Where it is not certain that a piece begins, the stretch simply
goes on, so the ids are always those of the whole text.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa

OTHER, LETTER, PUNCT, SPACE, WHITE, DIGIT, APOSTROPHE = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = PUNCT
    for lo, hi, c in ((65, 91, LETTER), (97, 123, LETTER), (48, 58, DIGIT), (9, 14, WHITE), (32, 33, SPACE)):
        out[lo:hi] = c
    out[39] = APOSTROPHE
    return out


def _borders() -> np.ndarray:
    """Whether a piece must begin between a byte of one class and the next."""
    out = np.zeros((8, 8), bool)
    for a in (LETTER, PUNCT, DIGIT, APOSTROPHE):
        out[a, SPACE] = out[a, WHITE] = True
        out[WHITE, a] = True
    for a in (LETTER, PUNCT, DIGIT):
        for b in (LETTER, PUNCT, DIGIT):
            out[a, b] = a != b
    return out.ravel()


CLASS, BORDER = _classes(), _borders()


KEY = 24  # bytes of the longest stretch that is remembered
JOINED = 128  # stretches that the library gets as one text
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _keys(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first bytes of stretches as three numbers each; the rest of a short one is zero."""
    padded = np.concatenate([data, np.zeros(KEY, np.uint8)])
    window = np.ndarray(len(data) + KEY - 7, "<u8", padded.tobytes(), strides=(1,))
    out = np.empty((len(low), KEY // 8), np.uint64)
    for k in range(KEY // 8):
        have = np.clip(size - 8 * k, 0, 8)
        word = window[np.minimum(low + 8 * k, len(window) - 1)]
        out[:, k] = np.where(have > 0, word & (np.uint64(2 ** 64 - 1) >> ((8 - have) * 8 % 64).astype(np.uint64)), np.uint64(0))
    return out


class PieceTokenizer:
    """Ids for batches of texts.  ``most`` bounds the stretches that are remembered and their ids."""

    def __init__(self, path: str, most: int = 300_000, end_id: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.end_id, self.clock = most, end_id, 0
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a byte-level token is a byte
        for token, k in vocabulary.items():
            self.width[k] = len(token)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.key, self.meta = np.empty((0, KEY // 8 + 1), np.uint64), np.empty((0, 4), np.int64)  # place, ids, uses, last use
        self.hash, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes and whose they are

    def _forget_rare(self) -> None:
        """Keep half as many stretches: those used again, the last used first."""
        again = np.flatnonzero(self.meta[:, 2] > 1)
        keep = again[np.argsort(-self.meta[again, 3], kind="stable")[:self.most // 2]]
        size = self.meta[keep, 1]
        before = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.meta[keep, 0] - before, size) + np.arange(size.sum())]
        self.flat, self.used = np.concatenate([flat, np.empty(1 << 16, np.uint32)]), len(flat)
        place = np.full(len(self.meta), -1)
        place[keep] = np.arange(len(keep))
        self.key, self.meta = self.key[keep], self.meta[keep]
        self.meta[:, 0] = before
        kept = np.isin(self.slot, keep)
        self.hash, self.slot = self.hash[kept], place[self.slot[kept]]

    def _ask(self, pieces: pa.Array, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches in a row, and how many each has; ``joint`` ones keep their pieces beside each other."""
        n = len(pieces)
        counts, flats = np.zeros(n, np.int64), []
        order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
        together = int(joint.sum())
        if together:
            some = pieces.take(pa.array(order[:together]))
            at = np.frombuffer(some.buffers()[1], np.int32, together + 1)
            raw = some.buffers()[2].to_pybytes()
            cuts = [*at[:-1:JOINED].tolist(), int(at[-1])]
            found = self._ids([raw[x:y] for x, y in zip(cuts, cuts[1:])])
            flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
            ends = np.cumsum(self.width[flat])
            last = np.searchsorted(ends, at[1:])
            if len(ends) and ends[-1] == at[-1] and (ends[last] == at[1:]).all():
                counts[order[:together]] = np.diff(last, prepend=-1)
                flats.append(flat)
            else:  # a token without its bytes: ask for each stretch alone
                together = 0
        if together < n:
            found = self._ids(pieces.take(pa.array(order[together:])).to_pylist())
            counts[order[together:]] = np.fromiter(map(len, found), np.int64, len(found))
            flats.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[order[together:]].sum())))
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(flats), np.stack([place, counts], axis=1)

    def _ids(self, raw: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]

    def _places(self, data: np.ndarray, low: np.ndarray, size: np.ndarray, pieces: pa.Array, joint: np.ndarray) -> np.ndarray:
        """Where the ids of distinct stretches are in ``self.flat``, and how many."""
        self.clock += 1
        if len(self.key) + len(low) > self.most or self.used > 4 * self.most:
            self._forget_rare()
        key = np.concatenate([_keys(data, low, size), size[:, None].astype(np.uint64)], axis=1)
        h = np.zeros(len(low), np.uint64)
        for k in range(key.shape[1]):
            h = (h ^ key[:, k]) * _MIX[0]
            h = (h ^ (h >> np.uint64(31))) * _MIX[1]
        out = np.empty((len(low), 2), np.int64)
        known = np.zeros(len(low), bool)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            slot = self.slot[at]
            known = (self.hash[at] == h) & (self.key[slot] == key).all(axis=1) & (size <= KEY)
            slot = slot[known]
            out[known] = self.meta[slot, :2]
            self.meta[slot, 2] += 1
            self.meta[slot, 3] = self.clock
        new = np.flatnonzero(~known)
        if len(new):
            flat, found = self._ask(pieces.take(pa.array(new)), joint[new])
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[:self.used], np.empty(self.used // 2 + 2 * len(flat), np.uint32)])
            self.flat[self.used:self.used + len(flat)] = flat
            found[:, 0] += self.used
            self.used += len(flat)
            out[new] = found
            short = np.flatnonzero(size[new] <= KEY)
            hashes, first = np.unique(h[new[short]], return_index=True)
            fresh = np.ones(len(hashes), bool)
            if len(self.hash):  # of two stretches with the same hash one is remembered
                fresh = self.hash[np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)] != hashes
            hashes, mine = hashes[fresh], short[first[fresh]]
            where = np.searchsorted(self.hash, hashes)
            self.slot = np.insert(self.slot, where, len(self.key) + np.arange(len(mine)))
            self.hash = np.insert(self.hash, where, hashes)
            self.key = np.concatenate([self.key, key[new[mine]]])
            self.meta = np.concatenate([self.meta, np.concatenate(
                [found[mine], np.tile([1, self.clock], (len(mine), 1))], axis=1)])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts ``data[offsets[i]:offsets[i + 1]]``, each followed by the end id.

        Returns all ids in a row and where each text's begin (one more entry than texts).
        """
        n = len(offsets) - 1
        data = data[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        raw = data.tobytes()
        odd = sorted({int(np.searchsorted(offsets, m.start(), side="right")) - 1
                      for s in self.special for m in re.finditer(re.escape(s), raw)})
        parts, lo = [], 0
        for k in [*odd, n]:  # texts that hold a special token go to the library whole
            if k > lo:
                parts.append(self._pieces(data[offsets[lo]:offsets[k]], offsets[lo:k + 1] - offsets[lo]))
            if k < n:
                ids = np.array([*self._ids([raw[offsets[k]:offsets[k + 1]]])[0], self.end_id], np.uint32)
                parts.append((ids, np.array([0, len(ids)])))
            lo = k + 1
        if len(parts) == 1:
            return parts[0]
        sizes = [np.diff(at) for _, at in parts]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if len(data) == 0:
            return np.full(n, self.end_id, np.uint32), np.arange(n + 1)
        cls = CLASS[data]
        high = data[:-1] == 0xC3  # the Latin letters of two bytes; not the signs for times and divided by
        if high.any():
            cls[1:][high & (data[1:] != 0x97) & (data[1:] != 0xB7)] = LETTER
        new = np.empty(len(data), bool)
        new[1:] = BORDER[(cls[:-1] << 3) | cls[1:]]
        begin = offsets[:-1][offsets[:-1] < len(data)]
        new[begin] = True
        # the last of several white characters is a piece of its own only beside what follows: no border after those
        new[1:] &= new[:-1] | (cls[:-1] != WHITE)
        new[begin] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.empty(len(coded.dictionary), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        low, size = starts[first], ends[first + 1] - starts[first]
        last = cls[low + size - 1]
        # a border is certain after a visible character and before a space
        joint = (cls[low] == SPACE) & ((last == LETTER) | (last == PUNCT) | (last == DIGIT) | (last == APOSTROPHE))
        place = self._places(data, low, size, coded.dictionary, joint)
        sizes = place[codes, 1]
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        ids = self.flat[np.repeat(place[codes, 0] - before[:-1], sizes) + np.arange(before[-1])]
        at = before[np.searchsorted(starts, offsets)]
        out = np.full(len(ids) + n, self.end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[at[1:] + np.arange(n)] = False
        out[keep] = ids
        return out, at + np.arange(n + 1)


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer for a file; it and its cache last as long as the worker."""
    if path not in _TOKENIZERS:
        give_back()
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def give_back() -> None:
    """Return to the system what this worker's earlier tasks have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
        if trim is not None:
            trim(0)


def forget() -> None:
    """Free the worker's tokenizers and their caches."""
    _TOKENIZERS.clear()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def encoded(batches, path: str, most: int = 2 << 20):
    """For Arrow batches of (doc_id, text): doc ids, ids in a row and their offsets, in small parts."""
    tok = tokenizer(path)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for lo, hi in slices(offsets, most):
            ids, at = tok.encode(data, offsets[lo:hi + 1])
            yield keys[lo:hi], ids, at
