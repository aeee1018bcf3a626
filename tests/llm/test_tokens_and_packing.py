import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarrystone.llm import packing, simple8b, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a  b   c\n\n d\t e \n", "it's l'eau  foo bar — x…y 12ab3 　z", "<|endoftext|> hi <|endoftext|>", "É\nà, ×2 ÷ 3.5%--'quote' ''s  ",
       " \x1c a\x85b ​", "  ", "\n", "x" * 5000, "日本語 text, 漢字.", "a  b  ", "_a_ b__c", "don't we'll I'm", "!" * 300]


FULL = Tokenizer.from_file(PATH)


def whole(text):
    return FULL.encode(text or "", add_special_tokens=False).ids + [0]


def test_piece_cache_gives_the_ids_of_the_whole_text():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "É", " ", "  ", "\n", "\t", ".", ",", "'", "'s", "-", "1", "23", " ", "—", "字", "_", "\x00", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)]
    tok = tokens.PieceTokenizer(PATH, most=500)
    data, offsets = tokens.utf8(pa.array(texts))
    for lo in range(0, len(texts), 50):
        part = offsets[lo:lo + 51]
        ids, at = tok.encode(data, part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [whole(t) for t in texts[lo:lo + 50]]


def test_piece_cache_without_the_special_token():
    rng = random.Random(2)
    alphabet = ["a", "Bc", "é", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", "'", "'s", "-", "12", "\u00a0", "\u3000", "—", "字", "_", "\x85"]
    texts = ["x\n\ny", "x \ny", "x\n y", "\n\ny", "a\n", "b", "a\n\n", "b", "\u3000\ny", "one.\n\nTwo\t\t3\r\n'q'"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    tok = tokens.PieceTokenizer(PATH, most=500)
    tok.special = []  # no text goes to the library whole
    data, offsets = tokens.utf8(pa.array(texts))
    for lo in range(0, len(texts), 50):
        ids, at = tok.encode(data, offsets[lo:lo + 51])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            FULL.encode(t, add_special_tokens=False).ids + [0] for t in texts[lo:lo + 50]]


def test_words_that_go_to_the_library_together():
    """Many new words in a batch, long ones too, and hardly any that are remembered."""
    rng = random.Random(3)
    letters = "abcdefghéü19.,'—"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(60))) for _ in range(600)]
    tok = tokens.PieceTokenizer(PATH, most=1000)
    data, offsets = tokens.utf8(pa.array(texts))
    for lo, hi in tokens.slices(offsets, 20_000):
        ids, at = tok.encode(data, offsets[lo:hi + 1])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            FULL.encode(t, add_special_tokens=False).ids + [0] for t in texts[lo:hi]]


@pytest.mark.parametrize("seed", range(4))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 59, 60, 61, 4095, 4096, 4097, 20_000):
        for ids in (rng.integers(0, 50_257, n), np.zeros(n, int), rng.integers(0, 2 ** 50, n) * (rng.random(n) < 0.1), rng.integers(0, 2, n)):
            blocks = simple8b.encode(ids)
            places = np.cumsum([0, *map(len, blocks)])[:-1]
            assert (simple8b.decode(b"".join(blocks), places) == ids).all()
    block = bytearray(simple8b.encode(np.arange(100))[0])
    block[-1] ^= 1
    with pytest.raises(ValueError):
        simple8b.decode(bytes(block), [0])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, length int, shard string")


ROWS = [(k * 3, t) for k, t in enumerate(ODD)] + [(-5, None), (7, "word " * 9000), (8, "same"), (9, "same"), (1000, "end"), (1000, "end")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    got = sorted(map(tuple, token_files.token_round_trip(docs(spark, ROWS).repartition(3), PATH).collect()))
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: r[0]):
        ids = whole(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)
    assert token_files.token_round_trip(docs(spark, ROWS).limit(0), PATH).count() == 0


def test_packing_holds_every_piece_once(spark):
    got = packing.pack_sequences(docs(spark, ROWS * 3), PATH, capacity=256, rounds=40).collect()
    want = []
    for i, t in ROWS * 3:
        ids = whole(t)
        first = len(ids) if len(ids) <= 256 else (len(ids) % 256 or 256)
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(rows) <= -(-sum(r["length"] for r in got) // 256) + 2
    assert packing.pack_sequences(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(513, np.int64)
    np.add.at(counts, rng.integers(1, 512, 4000) // (1 + seed) + 1, 1)
    counts[512] = 0
    patterns = packing.plan(counts, 512, rounds=60)
    made = np.zeros(513, np.int64)
    for pattern, times in patterns:
        assert sum(s * n for s, n in pattern.items()) <= 512
        for s, n in pattern.items():
            made[s] += n * times
    assert (made[:512] == counts[:512]).all()
    bound = -(-int((np.arange(513) * counts).sum()) // 512)
    assert sum(t for _, t in patterns) <= max(bound * 1.03 + 2, bound + int(counts[257:].sum()) * 0.35)
