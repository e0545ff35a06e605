import numpy as np
import pytest

from pairlab.llm import ego_join


def brute(rows, threshold):
    width = max((len(v) for _, v in rows if v), default=0)

    def sound(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    good = [i for i, (_, v) in enumerate(rows) if sound(v)]
    x = np.zeros((len(good), width))
    for k, i in enumerate(good):
        x[k, : len(rows[i][1])] = rows[i][1]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(good) else x
    near = x @ x.T >= threshold
    out = {i: (0, rows[i][0]) for i in range(len(rows))}
    label = list(range(len(good)))
    moved = True
    while moved:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(good))]
        moved, label = new != label, new
    for k, i in enumerate(good):
        ids = [rows[good[j]][0] for j in range(len(good)) if label[j] == label[k]]
        out[i] = (int(near[k].sum()) - 1, min((d for d in ids if d is not None), default=None))
    return sorted(((rows[i][0], n, c, rows[i][0] == c) for i, (n, c) in out.items()), key=str)


def rows_of(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, width))
    out = [(i, (centres[i % len(centres)] + spread * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]
    out += [(1000 + i, out[0][1]) for i in range(30)]  # a hot vector
    out += [(2000 + i, (np.array(out[1][1]) * (i + 1)).astype(np.float32).tolist()) for i in range(5)]
    return out


@pytest.mark.parametrize("block_rows, threshold, width", [(4096, 0.95, 16), (7, 0.95, 16), (5, 0.8, 3), (3, 0.99, 2)])
def test_equals_brute_force(spark, block_rows, threshold, width):
    rows = rows_of(block_rows, 60, width, 0.15)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, n int")
    got = ego_join.near_duplicate_vectors(df, threshold, block_rows=block_rows, tile_rows=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, threshold)


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [2.0, 0.1, 0.0]), (None, [0.0, 1.0]), (10, [-1.0, 0.0]), (7, [1.0, 0.0]),
        (11, [1e-30, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ego_join.near_duplicate_vectors(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 0.95)
    assert ego_join.near_duplicate_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in ego_join.near_duplicate_vectors(df.limit(1)).collect()] == [(1, 0, 1, True)]


def test_far_blocks_are_skipped(spark):
    blocks = spark.createDataFrame(
        [(i, [float(i), 0.0], [i + 0.5, 1.0]) for i in range(40)], "node bigint, lo array<double>, hi array<double>"
    )
    got = {tuple(r) for r in ego_join._block_pairs(blocks, 40, 1.0).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a, 40) if max(0, b - a - 0.5) ** 2 <= 1.0}
