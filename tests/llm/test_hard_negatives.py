import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, vector array<double>, row int, anchor string, vec int"


def brute(rows, anchors, positives=5, negatives=3):
    """Plain Python integers, row by row."""
    sound = [
        (n, i, lab, [int(x) for x in v])
        for n, (i, lab, v) in enumerate(rows)
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]

    def rank(scored):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))

    out = []
    for n, i, lab, v in sound:
        if not anchors(i):
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, k) for m, j, k, w in sound if m != n]
        for ps, p, _ in rank([o for o in others if o[2] == lab])[:positives]:
            fit = [o for o in others if o[2] != lab and 50 * ps <= 100 * o[0] <= 95 * ps]
            out += [(i, p, r + 1, q, ps, s) for r, (s, q, _) in enumerate(rank(fit)[:negatives])]
    return sorted(out, key=str)


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = H.mine(df, F.col("vec_id") % 3 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def some(n, seed, top=40, width=6, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [float(rng.randrange(-top, top)) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"anchor_rows": 7, "task_rows": 11, "tile_rows": 4}])
def test_against_brute_force(spark, sizes):
    # few different values: many ties
    rows = some(90, 1) + [(90 + i, lab, v) for i, lab, v in some(60, 2, top=2)]
    got = run(spark, rows, **sizes)
    assert len(got) > 100
    assert got == brute(rows, lambda i: i % 3 == 0)


def test_large_components(spark):
    rows = some(40, 3, top=3_000_000)
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    rows[0] = (0, 1, [1e12] * 6)
    with pytest.raises(ValueError, match="too large"):
        run(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(30, 4, top=9) + [
        (30, None, [1.0] * 6), (33, 1, None), (36, 1, [nan] * 6), (39, 0, [1.0, None, 2.0]), (42, 2, [-inf] * 6),
        (45, 1, []), (48, 1, [7.0]), (51, 0, [0.0] * 6), (None, 1, [9.0] * 6), (None, 0, [9.0] * 6),
        (54, 2, [9.0] * 6), (54, 2, [9.0] * 6), (57, 9, [5.0] * 6),
    ]
    sizes = {"anchor_rows": 5, "task_rows": 9, "tile_rows": 3}
    assert run(spark, rows, **sizes) == brute(rows, lambda i: i is not None and i % 3 == 0)
    assert run(spark, []) == run(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == run(spark, [(0, None, [1.0])]) == []


@pytest.mark.parametrize("width, bound", [(1, 5), (64, 70_000), (1024, 2**50), (3000, 2**50)])
def test_products_are_exact(width, bound):
    span = min(width, H.SPAN)
    primes = H.primes_for(bound, span)
    assert all((p // 2) ** 2 * span <= 2**24 for p in primes)
    side = int((bound / width) ** 0.5)
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-side, side + 1, (9, width)) for _ in range(2))
    a[0], b[0], b[1] = side, side, -side
    got = H.products(H.residues(a, primes), H.residues(b, primes), primes, span)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_limits_of_parameters(spark):
    df = spark.createDataFrame([(1, 0, [1.0])], "vec_id bigint, label int, vector array<double>")
    for bad in ({"positives": 0}, {"negatives": 0}, {"low": 95}):
        with pytest.raises(ValueError):
            H.mine(df, F.lit(True), **bad)
