import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairlab.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fill(runs):
    """Bins of a plan: bin -> pieces by offset."""
    bins = {}
    for r in runs:
        for rank in range(r.lo, r.hi):
            n = rank - r.lo
            bins.setdefault(r.bin + n // r.per, []).append((r.offset + n % r.per * r.length, r.length))
    return {b: sorted(p) for b, p in bins.items()}


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 4096])
    high = rng.choice([capacity, max(1, capacity // 3), max(1, capacity // 10)])
    lengths = [rng.randint(1, high) for _ in range(rng.randint(0, 400))]
    if seed % 3 == 0:
        lengths += [rng.randint(1, high)] * 500
    bins = fill(packing.plan(Counter(lengths), capacity))
    placed = []
    for pieces in bins.values():
        at = 0
        for offset, n in pieces:
            assert offset == at
            at += n
            placed.append(n)
        assert at <= capacity
        assert sum(n > capacity // 3 for _, n in pieces) <= 2 or capacity // 3 * 3 < capacity
    assert sorted(placed) == sorted(lengths)
    assert sorted(bins) == list(range(len(bins)))
    # no bin may be emptied into the gap of another: best fit leaves at most one half-empty bin
    if lengths:
        halves = sum(sum(n for _, n in p) * 2 <= capacity for p in bins.values())
        assert halves <= 1
        assert len(bins) <= 2 * -(-sum(lengths) // capacity)


def test_large_pieces_pair_with_the_longest_that_fits():
    bins = fill(packing.plan({60: 1, 50: 1, 40: 1, 45: 1}, 100))
    assert sorted(sorted(n for _, n in p) for p in bins.values()) == [[40, 60], [45, 50]]


def brute_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(5)
    letters = "abzÉéßñ'ªµ·x01 9\n\t .,!*&<|>_-İΣσςا́‍\x1c\x85ﬁ中😀"
    whole = Tokenizer.from_file(PATH)
    for memory in (100_000, 50):
        encode = packing.Encoder(PATH, memory).encode
        for i in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
            text += " <|endoftext|> it's we'll" * (i % 50 == 0)
            want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert encode([text]) == [want], repr(text)


def test_rows(spark, frame, odd):
    df = frame(odd)
    rows = packing.pack(df, PATH, capacity=64, with_ids=True).collect()
    assert packing.pack(frame([]), PATH).count() == 0
    by_bin = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_bin.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    got = Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows)
    want = Counter()
    for i, text, _ in odd:
        ids = brute_ids(text)
        for k in range(0, len(ids), 64):
            want[(i, k // 64, k, tuple(ids[k : k + 64]))] += 1
    assert got == want
