"""Hard negatives by exact integer inner products in a residue number system.

Products of integer matrices are taken modulo several small primes in single precision, where every
partial sum stays exact, and the signed scores are rebuilt from their residues by the Chinese
remainder theorem.
"""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairlab.operators.indexing import dense_index
from pairlab.session import durable

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # a negative's score in hundredths of the positive's
ANCHOR_ROWS = 8192  # anchors of a block
TASK_ROWS = 32_768  # rows that meet a block of anchors in one task
TILE_ROWS = 256  # rows of one product
SPAN = 1024  # components of one exact partial sum, at most
LARGEST = 2**50  # scores lie below it, so that sums of residues and keys of scores fit 63 bits

FOUND = "anchor bigint, slot int, score bigint, row bigint"


def primes_for(bound: int, span: int) -> list[int]:
    """The largest primes whose residues keep ``span`` products exact in single precision, largest
    first, as many as tell all integers from ``-bound`` to ``bound`` apart."""
    top = 2 * isqrt(2**24 // span)  # centred residues reach half of it
    found: list[int] = []
    for n in range(top, 2, -1):
        if prod(found) > 2 * bound:
            break
        if all(n % k for k in range(2, isqrt(n) + 1)):
            found.append(n)
    if prod(found) <= 2 * bound:
        raise ValueError("the scores exceed what the primes can tell apart")
    return found


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of an integer matrix modulo each prime, in single precision."""
    out = []
    for p in primes:
        r = np.mod(x, p)
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int], span: int) -> np.ndarray:
    """Exact ``a @ b.T`` as signed 64-bit integers, of matrices given by their residues.

    The residues of the product are combined prime by prime: each step lifts the value so far to the
    next modulus. Values end within half the product of the primes, around zero.
    """
    value, modulus = None, 1
    for x, y, p in zip(a, b, primes):
        part = np.zeros((len(x), len(y)), dtype=np.int64)
        for at in range(0, x.shape[1], span):
            part += (x[:, at : at + span] @ y[:, at : at + span].T).astype(np.int64)
        if value is None:
            value = np.mod(part, p)
        else:
            step = np.mod(np.mod(part - value, p) * pow(modulus, -1, p), p)
            value += modulus * step
        modulus *= p
    value[value > modulus // 2] -= modulus
    return value


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``(anchor, row)`` and scores of each anchor's ``k`` highest allowed rows; the earlier row wins ties."""
    n = scores.shape[1]
    if np.count_nonzero(allowed) > 4 * k * len(scores):
        least = np.iinfo(np.int64).min
        # a score and a row's place in one number: no two are equal
        key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), least)
        key = np.partition(key, n - k, axis=1)[:, n - k :] if k < n else key
        at, column = np.nonzero(key != least)
        key = key[at, column]
        return at, n - 1 - np.mod(key, n), np.floor_divide(key, n)
    at, row = np.nonzero(allowed)
    return at, row, scores[at, row]


class Leaders:
    """The ``k`` best rows so far in each slot; rows come in order of their identifiers."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.least = np.full(slots, np.iinfo(np.int64).min)  # the last place's score, once all are taken
        self.slot = self.score = self.row = np.zeros(0, dtype=np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Rows that come later must have higher numbers, so that earlier ones win ties."""
        if not len(slot):
            return
        slot = np.concatenate([self.slot, slot])
        score, row = np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((row, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.least[slot[place == self.k - 1]] = score[full]
        self.slot, self.score, self.row = slot[place < self.k], score[keep], row[keep]


def _scan(width: int, primes: list[int], span: int, k: int, windows: bool, tile_rows: int):
    """Score each block of anchors against the rows that its tasks hold.

    Rows come sorted by block and task, anchors before other rows, rows in order of identifiers.
    Without ``windows`` the best rows of an anchor's own label are looked for, else the best rows of
    other labels between the low and the high score of each of its positives.
    """

    def matrix(column: pa.Array) -> np.ndarray:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(sizes), width))
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def run(batches):
        key, held, anchors = None, [], None
        labels: dict = {}

        def code(column) -> np.ndarray:
            return np.array([labels.setdefault(x, len(labels)) for x in column.to_pylist()], dtype=np.int64)

        def open_block():
            rows, names, x, limits = (np.concatenate(part) for part in zip(*held))
            held.clear()
            slots = len(rows) * (limits.shape[1] if windows else 1)
            return {"row": rows, "label": names, "x": residues(x, primes), "limits": limits, "leaders": Leaders(slots, k)}

        def compare(rows, names, x):
            for lo in range(0, len(rows), tile_rows):
                own = slice(lo, lo + tile_rows)
                scores = products(anchors["x"], residues(x[own], primes), primes, span)
                same = anchors["label"][:, None] == names[own][None, :]
                leaders = anchors["leaders"]
                if not windows:
                    allowed = same & (anchors["row"][:, None] != rows[own][None, :])
                    allowed &= scores > leaders.least[:, None]
                    at, j, score = best(scores, allowed, k)
                    leaders.add(at, score, rows[own][j])
                    continue
                wide = anchors["limits"].shape[1]
                other = ~same
                for slot in range(wide):
                    low, high = anchors["limits"][:, slot, 0], anchors["limits"][:, slot, 1]
                    floor = np.maximum(low - 1, leaders.least[slot::wide])
                    allowed = (scores > floor[:, None]) & (scores <= high[:, None]) & other
                    at, j, score = best(scores, allowed, k)
                    leaders.add(at * wide + slot, score, rows[own][j])

        def close():
            leaders = anchors["leaders"]
            wide = anchors["limits"].shape[1] if windows else 1
            columns = [anchors["row"][leaders.slot // wide], (leaders.slot % wide).astype(np.int32), leaders.score, leaders.row]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "score", "row"])

        for batch in batches:
            block, task, side, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = matrix(batch.column(5))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(task) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)]):
                if lo == hi:
                    continue
                if (block[lo], task[lo]) != key:
                    if anchors is not None:
                        yield close()
                    key, anchors = (block[lo], task[lo]), None
                    held.clear()
                    labels.clear()
                names = code(batch.column(4).slice(lo, hi - lo))
                if side[lo] == 0:
                    limits = np.zeros((hi - lo, 0, 2), dtype=np.int64)
                    if windows:
                        flat = batch.column(6).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                        limits = flat.reshape(hi - lo, -1, 2)
                    held.append((row[lo:hi], names, x[lo:hi], limits))
                    continue
                if anchors is None and not held:
                    continue  # a block that no anchor fell into
                if anchors is None:
                    anchors = open_block()
                compare(row[lo:hi], names, x[lo:hi])
        if anchors is not None:
            yield close()

    return run


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best of each group over all tasks, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dealt(anchors: DataFrame, rows: DataFrame, blocks: int, tasks: int, limits: Column) -> DataFrame:
    """Every block of anchors next to the rows of each of its tasks."""
    columns = ["block", "task", "side", "row", "label", "vec", "limits"]
    none = F.lit(None).cast("array<bigint>")
    near = anchors.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))).alias("task"),
        F.lit(0).alias("side"), "row", "label", "vec", limits.alias("limits"),
    )
    far = rows.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
        F.pmod(F.xxhash64("row"), F.lit(tasks)).alias("task"),
        F.lit(1).alias("side"), "row", "label", "vec", none.alias("limits"),
    )
    both = near.select(*columns).unionByName(far.select(*columns))
    return both.repartition(blocks * tasks, "block", "task").sortWithinPartitions("block", "task", "side", "row")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    anchor_rows: int = ANCHOR_ROWS,
    task_rows: int = TASK_ROWS,
    tile_rows: int = TILE_ROWS,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "vector",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vec_col`` holds whole numbers. A row's score is its inner product with the anchor, exactly; the
    higher comes first, and of equals the smaller identifier (a null one last). An anchor's positives
    are its first ``positives`` other rows of the same label. For each of them the first ``negatives``
    rows of other labels are returned whose score is ``low`` to ``high`` hundredths of the positive's.

    Rows take no part whose label or vector is null, or whose vector holds a null, infinite or
    undefined component. Shorter vectors count as padded with zeros, empty ones as zero. Repeated rows
    are rows of their own: copies are each other's positives, and a repeated anchor is answered once
    for each. A null identifier is no anchor. Other columns are ignored, whatever their names; an
    empty table, or one without anchors, gives an empty result. Components so large that a score
    could reach 2^50 are an error.

    Anchors are cut into blocks, and rows are dealt to tasks by number, so that no label, however
    frequent, is a hot group. A task holds one block of anchors and one tile of rows.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("positives and negatives must be counted from one")
    if not 0 <= low < high:
        raise ValueError("the window must be 0 <= low < high")
    sound = F.expr(
        "vec IS NOT NULL AND label IS NOT NULL"
        " AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    taken = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vec_col).cast(T.ArrayType(T.DoubleType())).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where(sound)
    # numbered in order of the identifiers, so that the smaller number wins ties
    rows = dense_index(taken, [F.col("id").asc_nulls_last(), F.xxhash64("vec")], "row")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    size = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"),
        F.max(F.size("vec")).alias("width"), F.max(norm).alias("norm"),
    ).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not size.anchors:
        return rows.sparkSession.createDataFrame([], schema)
    if size.norm >= LARGEST:
        raise ValueError("components are too large: a score could reach 2^50")
    # no product exceeds the largest squared length
    width = max(1, size.width)
    span = min(width, SPAN)
    primes = primes_for(int(size.norm) + 1, span)
    blocks, tasks = -(-size.anchors // anchor_rows), -(-size.rows // task_rows)
    anchors = rows.where("anchor")
    none = F.lit(None).cast("array<bigint>")
    near = _dealt(anchors, rows, blocks, tasks, none).mapInArrow(
        _scan(width, primes, span, positives, False, tile_rows), FOUND
    )
    chosen = durable(_top(near, ["anchor"], positives).select("anchor", "rank", "score", "row"))
    # a place without a positive, or with a negative score, has a window that nothing lies in
    ends = F.expr(
        f"flatten(transform(transform(sequence(1, {positives}), i -> coalesce(try_element_at(scores, i), -1L)),"
        f" s -> if(s < 0, array(1L, 0L), array(({low} * s + 99) div 100, ({high} * s) div 100))))"
    )
    windows = chosen.groupBy("anchor").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores")
    )
    armed = anchors.join(windows.withColumnRenamed("anchor", "row"), "row")
    far = _dealt(armed, rows, blocks, tasks, ends).mapInArrow(
        _scan(width, primes, span, negatives, True, tile_rows), FOUND
    )
    last = _top(far, ["anchor", "slot"], negatives).select(
        "anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("row").alias("negative"), F.col("score").alias("negative_score")
    )
    first = chosen.select(
        "anchor", F.col("rank").alias("place"), F.col("row").alias("positive"), F.col("score").alias("positive_score")
    )
    named = rows.select("row", "id")

    def name(df: DataFrame, number: str, id_name: str) -> DataFrame:
        lookup = named.select(F.col("row").alias(number), F.col("id").alias(id_name))
        return df.join(lookup, number)

    out = last.join(first, ["anchor", "place"])
    for number in ("anchor", "positive", "negative"):
        out = name(out, number, f"{number}_id")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


SQL = """
WITH v AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id
WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
