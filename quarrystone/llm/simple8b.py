"""Simple-8b blocks of token ids, encoded and decoded with whole-array operations.

A 64-bit word holds a selector in its low four bits and as many equally wide
ids above as fit in sixty bits.  Ids too wide for the packed stream (from
``ESCAPE_BITS`` on) are written as zero and listed with their places after the
words.  Blocks hold ``BLOCK`` ids and can be decoded alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the published scheme: ids in a word and bits of each, by selector from 2 on.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
FIRST_SELECTOR = 2
BLOCK = 4096
ESCAPE_BITS = 20
PAD = 64
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIIII")


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, one at least (ids are below 2**53)."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)


def encode(ids: np.ndarray) -> list[bytes]:
    """The ids as a list of blocks."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return []
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (blocks - 1)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:len(ids)] = ids
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    wide = grid >= np.uint64(1 << ESCAPE_BITS)
    escapes = np.nonzero(wide) if wide.any() else (np.empty(0, int), np.empty(0, int))
    escaped = grid[escapes]
    grid[escapes] = 0
    # widest of the next c ids, for every c of a selector, from windows of powers of two
    bits = _bits(grid)
    windows = {1: bits}
    c = 1
    while c < 32:
        a = windows[c]
        b = a.copy()
        np.maximum(a[:, :-c], a[:, c:], out=b[:, :-c])
        windows[2 * c] = b
        c *= 2
    pick = np.zeros(grid.shape, np.uint8)
    open_ = np.ones(grid.shape, bool)
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        half = 1 << (count.bit_length() - 1)
        most = windows[half]
        fits = most <= width
        if count > half:
            fits[:, :half - count] &= most[:, count - half:] <= width
        chosen = open_ & fits
        pick[chosen] = k
        open_ &= ~fits
    # walk all blocks at once, a word each step
    counts = np.array(COUNTS)
    at, rows, live = np.zeros(blocks, np.int64), np.arange(blocks), np.ones(blocks, bool)
    which, where, chosen = [], [], []
    while len(rows):
        k = pick[rows, at[rows]]
        which.append(rows)
        where.append(at[rows].copy())
        chosen.append(k)
        at[rows] += counts[k]
        live = at[rows] < sizes[rows]
        rows = rows[live]
    which, where, chosen = map(np.concatenate, (which, where, chosen))
    order = np.argsort(which, kind="stable")
    which, where, chosen = which[order], where[order], chosen[order]
    words = np.empty(len(which), np.uint64)
    flat, base = grid.ravel(), which * (BLOCK + PAD) + where
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        of = np.flatnonzero(chosen == k)
        if len(of):
            word = np.full(len(of), k + FIRST_SELECTOR, np.uint64)
            for j in range(count):
                word |= flat[base[of] + j] << np.uint64(4 + j * width)
            words[of] = word
    per = np.bincount(which, minlength=blocks)
    ends = np.cumsum(per)
    out = []
    for b in range(blocks):
        mine = escapes[0] == b
        body = words[ends[b] - per[b]:ends[b]].astype("<u8").tobytes()
        extra = escapes[1][mine].astype("<u4").tobytes() + escaped[mine].astype("<u8").tobytes()
        body += extra
        out.append(HEADER.pack(MAGIC, int(sizes[b]), int(per[b]), int(mine.sum()), zlib.crc32(body)) + body)
    return out


def decode(payload: bytes, offsets: list[int] | np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``offsets`` of ``payload``, in a row."""
    words, sizes, per, escapes = [], [], [], []
    for b, at in enumerate(offsets):
        magic, n, n_words, n_escapes, crc = HEADER.unpack_from(payload, at)
        low = at + HEADER.size
        high = low + 8 * n_words + 12 * n_escapes
        if magic != MAGIC or zlib.crc32(payload[low:high]) != crc:
            raise ValueError(f"block {b} is damaged")
        words.append(np.frombuffer(payload, "<u8", n_words, low))
        sizes.append(n)
        per.append(n_words)
        if n_escapes:
            mid = low + 8 * n_words
            escapes.append((b, np.frombuffer(payload, "<u4", n_escapes, mid),
                            np.frombuffer(payload, "<u8", n_escapes, mid + 4 * n_escapes)))
    if not sizes:
        return np.empty(0, np.uint64)
    words, sizes, per = np.concatenate(words), np.array(sizes), np.array(per)
    pick = (words & np.uint64(15)).astype(np.int64) - FIRST_SELECTOR
    count = np.array(COUNTS)[pick]
    before = np.cumsum(count) - count
    first = np.cumsum(per) - per
    block = np.repeat(np.arange(len(sizes)), per)
    place = before - before[first][block] + (np.arange(len(sizes)) * (BLOCK + PAD))[block]
    grid = np.zeros((len(sizes), BLOCK + PAD), np.uint64)
    flat = grid.ravel()
    for k, (c, width) in enumerate(zip(COUNTS, WIDTHS)):
        of = np.flatnonzero(pick == k)
        if len(of):
            mask = np.uint64((1 << width) - 1)
            for j in range(c):
                flat[place[of] + j] = (words[of] >> np.uint64(4 + j * width)) & mask
    for b, at, values in escapes:
        grid[b, at] = values
    full = grid[:, :BLOCK]
    return full[np.arange(BLOCK) < sizes[:, None]]
