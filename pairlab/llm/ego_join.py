"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from pairlab.llm.components import connected_components
from pairlab.operators.indexing import dense_index
from pairlab.session import durable

THRESHOLD = 0.95
DIMENSIONS = 8  # leading principal dimensions of the grid
BLOCK_ROWS = 4096
TILE_ROWS = 256  # smallest interval of the recursion within a task
FANOUT = 8  # children of an interval of blocks
SLACK = 1e-9  # rounding of distances when intervals are skipped
BORDER = 1e-10  # cosines this close to the threshold are computed again, exactly rounded


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_dimensions(classes: DataFrame, width: int, dimensions: int) -> np.ndarray:
    """The leading eigenvectors of the second moments of all unit vectors, as columns.

    Each task sends ``width ** 2`` sums, whatever its rows.
    """

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            u = _unit(_matrix(batch.column(0), width))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["slot", "value"]
        )

    moments = np.zeros(width * width)
    sums = classes.select("vec").mapInArrow(run, "slot bigint, value double")
    for slot, value in sums.groupBy("slot").agg(F.sum("value")).toLocalIterator():
        moments[slot] = value
    _, vectors = np.linalg.eigh(moments.reshape(width, width))
    return np.ascontiguousarray(vectors[:, ::-1][:, :dimensions])


def _boxes(points: np.ndarray, tile_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest corner of each tile of rows."""
    starts = np.arange(0, len(points), tile_rows)
    return np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)


def _reachable(a, b, limit: float) -> np.ndarray:
    """Pairs of tiles that are not provably farther apart than the square root of ``limit``."""
    gap = np.maximum(a[0][:, None] - b[1][None, :], b[0][None, :] - a[1][:, None])
    return (np.maximum(gap, 0.0) ** 2).sum(axis=2) <= limit


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    dot, xx, yy = fsum(x * y), fsum(x * x), fsum(y * y)
    return dot / sqrt(xx * yy)


def _join(width: int, basis: np.ndarray, threshold: float, tile_rows: int):
    """Compare the two blocks of each pair, tile by tile.

    Rows come sorted by pair, the first block's before the second's. A task holds one block. For
    each vector it emits how many rows it is linked to, and at most one edge, which keeps the
    components whole however many pairs match.
    """
    limit = 2 - 2 * threshold + SLACK

    def run(batches):
        state: dict = {"key": None}
        out: list = []

        def find(i):
            parent = state["parent"]
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def compare(rows, inside):
            home = state["home"]
            links = np.zeros(len(rows["seq"]), dtype=np.int64)
            peer = np.full(len(links), -1)
            reach = _reachable(home["boxes"], rows["boxes"], limit)
            for i, j in zip(*np.nonzero(reach)):
                if inside and j < i:
                    continue
                h = slice(i * tile_rows, (i + 1) * tile_rows)
                v = slice(j * tile_rows, (j + 1) * tile_rows)
                cos = rows["unit"][v] @ home["unit"][h].T
                near = cos >= threshold
                for r, c in zip(*np.nonzero(np.abs(cos - threshold) < BORDER)):
                    x, y = rows["raw"][v][r], home["raw"][h][c]
                    near[r, c] = _exact(x, y) >= threshold
                if inside and i == j:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                links[v] += near @ home["n"][h]
                if not (inside and i == j):
                    state["links"][h] += near.T @ rows["n"][v]
                at, own = np.nonzero(near)
                at, own = at + v.start, own + h.start
                if inside:
                    pairs = np.stack([at, own], axis=1)[own > at if i == j else slice(None)]
                else:
                    first = own[np.searchsorted(at, at)]
                    fresh = peer[at] < 0
                    peer[at[fresh]] = first[fresh]
                    pairs = np.unique(np.stack([peer[at], own], axis=1), axis=0)
                if inside and len(pairs) > 4 * tile_rows:
                    # rows with the same first match are joined through it
                    first = pairs[np.searchsorted(pairs[:, 0], pairs[:, 0]), 1]
                    star = np.stack([first, pairs[:, 1]], axis=1)
                    heads = pairs[np.unique(pairs[:, 0], return_index=True)[1]]
                    pairs = np.unique(np.concatenate([star, heads]), axis=0)
                for a, b in pairs.tolist():
                    a, b = find(a), find(b)
                    if a != b:
                        state["parent"][max(a, b)] = min(a, b)
            if inside:
                state["links"] += links
            else:
                met = links > 0
                if met.any():
                    out.append((rows["seq"][met], links[met], home["seq"][peer[met]]))

        def close():
            if state["key"] is None:
                return
            if not state["opened"]:
                open_home()
            links = state["links"]
            met = np.flatnonzero(links > 0)
            if len(met):
                seq = state["home"]["seq"]
                roots = np.array([find(i) for i in met.tolist()])
                out.append((seq[met], links[met], seq[roots]))

        def rows_of(seq, n, raw):
            unit = _unit(raw)
            return {"seq": seq, "n": n, "raw": raw, "unit": unit, "boxes": _boxes(unit @ basis, tile_rows)}

        def open_home():
            seq, n, raw = (np.concatenate(x) for x in zip(*state["waiting"]))
            state["home"] = rows_of(seq, n, raw)
            state["links"] = np.zeros(len(seq), dtype=np.int64)
            state["parent"] = list(range(len(seq)))
            state["waiting"] = []
            state["opened"] = True
            if state["key"][0] == state["key"][1]:
                compare(state["home"], True)

        def flush():
            seq, links, peer = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(seq), pa.array(links), pa.array(peer)], names=["seq", "links", "peer"]
            )

        for batch in batches:
            a, b, side, seq, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            raw = _matrix(batch.column(5), width)
            moved = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])
            cuts = np.flatnonzero(moved) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
                key = (int(a[lo]), int(b[lo]))
                if key != state["key"]:
                    close()
                    state = {"key": key, "waiting": [], "opened": False}
                part = (seq[lo:hi], n[lo:hi], raw[lo:hi])
                if side[lo] == 0:
                    state["waiting"].append(part)
                else:
                    if not state["opened"]:
                        open_home()
                    compare(rows_of(*part), False)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def _block_pairs(blocks: DataFrame, n_blocks: int, limit: float) -> DataFrame:
    """Pairs ``(a, b)`` of blocks, ``a <= b``, that are not provably too far apart.

    Intervals of the sequence are joined recursively from the whole down: a pair of intervals is
    opened only if the boxes of both lie within reach.
    """
    levels = [blocks]
    while FANOUT ** (len(levels) - 1) < n_blocks:
        below = levels[-1]
        levels.append(
            below.groupBy((F.col("node") / FANOUT).cast("bigint").alias("node")).agg(
                F.expr("array_agg(lo)").alias("lo"), F.expr("array_agg(hi)").alias("hi")
            ).select(
                "node",
                F.expr("transform(lo[0], (x, i) -> array_min(transform(lo, v -> v[i])))").alias("lo"),
                F.expr("transform(hi[0], (x, i) -> array_max(transform(hi, v -> v[i])))").alias("hi"),
            )
        )
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    gap = "zip_with(zip_with(a_lo, b_hi, (x, y) -> x - y), zip_with(b_lo, a_hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    near = F.expr(f"aggregate({gap}, 0D, (s, x) -> s + x * x) <= {limit!r}D")
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", (F.col("node") / FANOUT).cast("bigint"))
        side = lambda s: child.select(
            F.col("up").alias(s), F.col("node").alias(f"{s}_n"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")
        )
        pairs = (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .where("a_n <= b_n")
            .where(near)
            .select(F.col("a_n").alias("a"), F.col("b_n").alias("b"))
        )
    return pairs


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    dimensions: int = DIMENSIONS,
    block_rows: int = BLOCK_ROWS,
    tile_rows: int = TILE_ROWS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row.

    Rows are linked if the cosine of their vectors, in double precision, is at least ``threshold``.
    ``n_links`` counts the other rows a row is linked to; ``component_id`` is the smallest
    identifier reachable by links; ``kept`` says that it is the row's own.

    Vectors that are null, empty or zero, or hold a null, infinite or undefined component, are linked
    with nothing and stand alone. Shorter vectors count as padded with zeros. Repeated rows are
    linked like other copies. A null identifier never names a component that holds another. Other
    columns are ignored; an empty table gives an empty result.

    Equal vectors are one class, compared once. Classes are sorted by their cells in a grid, as
    wide as the largest linked distance, on the leading principal dimensions, and cut into
    blocks. Only pairs of blocks in reach of each other are compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    element = vectors.schema[vec_col].dataType.elementType
    kind = element if isinstance(element, (FloatType, DoubleType)) else DoubleType()
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vec_col).cast(ArrayType(kind)).alias("vec")
    ).withColumn(
        "sound",
        F.expr(
            "vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
            " AND exists(vec, x -> x <> 0)"
        ),
    )
    alone = rows.where(~F.col("sound")).select(
        F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
        F.col("id").alias("component_id"), F.lit(True).alias("kept"),
    )
    sound = rows.where("sound").select("id", "vec")
    classes = durable(
        sound.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    )
    width, n_classes = classes.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    if not n_classes:
        return alone
    basis = principal_dimensions(classes, width, min(dimensions, width))
    eps = max(1e-6, sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches):
        for batch in batches:
            points = _unit(_matrix(batch.column(0), width)) @ basis
            cells = np.floor(points / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(cells)), pa.array(list(points))],
                names=["vec", "n", "least", "cell", "point"],
            )

    least = classes.schema["least"].dataType.simpleString()
    vec = f"array<{kind.simpleString()}>"
    placed = classes.mapInArrow(
        place, f"vec {vec}, n bigint, least {least}, cell array<int>, point array<double>"
    )
    ordered = durable(
        dense_index(placed, ["cell", "point"], "seq").withColumn(
            "block", F.floor(F.col("seq") / block_rows)
        )
    )
    corner = lambda f: F.array(*[f(F.col("point")[i]) for i in range(basis.shape[1])])
    blocks = durable(
        ordered.groupBy(F.col("block").alias("node")).agg(
            corner(F.min).alias("lo"), corner(F.max).alias("hi")
        )
    )
    n_blocks = -(-n_classes // block_rows)
    pairs = durable(_block_pairs(blocks, n_blocks, 2 - 2 * threshold + SLACK))
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(
        pairs.where("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block"))
    )
    compared = durable(
        ordered.select("block", "seq", "n", "vec")
        .join(sides, "block")
        .select("a", "b", "side", "seq", "n", "vec")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b", "side")
        .mapInArrow(_join(width, basis, threshold, tile_rows), "seq bigint, links bigint, peer bigint")
    )
    roots = connected_components(
        compared.select(F.col("seq").alias("a"), F.col("peer").alias("b"))
    ).withColumnRenamed("node", "seq")
    links = compared.groupBy("seq").agg(F.sum("links").alias("links"))
    grouped = durable(
        ordered.select("seq", "vec", "n", "least")
        .join(links, "seq", "left")
        .join(roots, "seq", "left")
        .select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "seq").alias("root"))
    )
    named = grouped.join(
        grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root"
    ).select("vec", "n_links", "component_id")
    return (
        sound.join(named, "vec")
        .select(
            F.col("id").alias(id_col),
            "n_links",
            "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
        .unionByName(alone)
    )
