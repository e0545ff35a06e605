import random
import re

import numpy as np
import pytest
import xxhash

from pairlab.llm import simhash
from pairlab.llm.components import connected_components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a B c", "É é e a b", "a b c d " * 50])
def test_fingerprint(text):
    assert simhash.simhash(text) % (1 << 64) == brute_print(text)


@pytest.mark.parametrize("tile_rows, radius", [(4096, 2), (3, 2), (5, 3), (2, 0)])
def test_links_join_what_brute_force_joins(spark, tile_rows, radius):
    rng = random.Random(tile_rows)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints)[:25]:  # chains and clusters around some
        for _ in range(6):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = connected_components(simhash.links(df, radius, tile_rows)).collect()
    root = {r.node: r.root for r in got}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= radius]
    want = brute_components(pairs, signed)
    assert {n: root.get(n, n) for n in signed} == want


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e}
    assert got == brute_components(edges, nodes)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert connected_components(none).count() == 0


def test_odd_rows(spark, frame, odd):
    got = simhash.near_duplicates(frame(odd)).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    zero = "0" * 16
    assert by[1] == by[2] == by[3] == {(zero, 1)}
    assert len(by[4]) == 1 and next(iter(by[4]))[1] == 4
    assert by[None] == {(zero, 1), next(iter(by[4]))}
    assert simhash.near_duplicates(frame([])).count() == 0
    only = simhash.near_duplicates(frame([(None, "a b c d", "a")])).first()
    assert only.component_id is None


def test_keep_one(spark, frame, odd):
    df = frame([*odd, (None, "another text without any number at all", "z"), (None, "another text without any number at all", "z")])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 5, 6]
    assert [r.text for r in rows if r.doc_id is None] == ["another text without any number at all"]
