"""Near-duplicate texts: SimHash and MinHash bands propose groups, exact Jaccard of word shingles decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pairlab.llm import simhash
from pairlab.llm.components import connected_components
from pairlab.session import durable

SHINGLE_WORDS = 5
SEED = 42
SIMILARITY = (4, 5)  # least Jaccard similarity of a link, as a fraction
# A pair at similarity s shares no band with probability (1 - s ** BAND_ROWS) ** BANDS: 3e-6 at 0.8.
BANDS, BAND_ROWS = 32, 5
# Mean rows and shingles of a tile at most, dealt by hash; a task holds two tiles at once.
TILE_ROWS, TILE_SHINGLES = 512, 1 << 20
COLUMNS = 2048  # shingles counted at once

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; a shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < SHINGLE_WORDS:
        parts = [b" ".join(tokens)]
    else:
        parts = map(b" ".join, zip(*(tokens[i:] for i in range(SHINGLE_WORDS))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], dtype=np.uint64))


def _class(hashes: np.ndarray) -> int:
    """Number of the set of shingles; equal texts share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is set if it is in over half of their hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0])


def _bands(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(h), 1 << 12):
        part = h[lo : lo + (1 << 12)]
        for i, (f, s) in enumerate(zip(_FACTORS, _SHIFTS)):
            least[i] = min(least[i], (part * f + s).min())
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _described(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_row``, its class ``_cls``, shingle count ``_n``, fingerprint ``_fp`` and band keys ``_keys``, stored once."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            cls, sizes, prints, keys = [], [], [], []
            for t in batch.column(at):
                found = shingles(t.as_py())
                cls.append(_class(found))
                sizes.append(len(found))
                prints.append(_fingerprint(found))
                keys.append(_bands(found))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(cls, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names, "_cls", "_n", "_fp", "_keys"],
            )

    added = [
        StructField("_cls", LongType()),
        StructField("_n", LongType()),
        StructField("_fp", LongType()),
        StructField("_keys", ArrayType(LongType())),
    ]
    return durable(numbered.mapInArrow(run, StructType([*numbered.schema.fields, *added])))


def similar(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``a`` reach the similarity with which of ``b``; counts are exact."""
    num, den = SIMILARITY
    sizes = np.array([len(x) for x in [*a, *b]], dtype=np.int64)
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, slot, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set is common to no two
    owner, slot = owner[shared[slot]], (np.cumsum(shared) - 1)[slot[shared[slot]]]
    order = np.argsort(slot, kind="stable")
    owner, slot = owner[order], slot[order]
    common = np.zeros((len(a), len(b)), dtype=np.int64)
    total = int(shared.sum())
    for lo in range(0, total, COLUMNS):
        i, j = np.searchsorted(slot, [lo, lo + COLUMNS])
        width = min(COLUMNS, total - lo)
        held = np.zeros((len(sizes), width), dtype=np.float32)
        held[owner[i:j], slot[i:j] - lo] = 1
        common += np.rint(held[: len(a)] @ held[len(a) :].T).astype(np.int64)
    both = sizes[: len(a), None] + sizes[None, len(a) :]
    return (num + den) * common >= num * both


def _labels(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least number reachable by links of rows (from 0) and columns (after them)."""
    n, m = near.shape
    rows, columns = np.arange(n), np.arange(n, n + m)
    top = n + m
    while True:
        a = np.minimum(rows, np.where(near, columns[None, :], top).min(axis=1))
        b = np.minimum(columns, np.where(near, a[:, None], top).min(axis=0))
        if (a == rows).all() and (b == columns).all():
            return a, b
        rows, columns = a, b


def _compare(batches):
    """Edges that join the similar sets of each pair of tiles, one for each row at most.

    Rows arrive sorted by group and tiles; ``second`` tells the rows of the second tile.
    """
    key, rows = None, []

    def close():
        a = [(c, s) for c, second, s in rows if not second]
        b = [(c, s) for c, second, s in rows if second] or a
        la, lb = _labels(similar([s for _, s in a], [s for _, s in b])) if a else ((), ())
        names = [c for c, _ in [*a, *b]]
        joined = [(c, names[x]) for c, x in zip(names, [*la, *lb]) if c != names[x]]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in joined], pa.int64()) for i in (0, 1)], names=["a", "b"]
        )

    for batch in batches:
        group, first, last, second, cls, found = batch.columns
        for *now, side, c, s in zip(
            group.to_pylist(), first.to_pylist(), last.to_pylist(), second.to_pylist(), cls.to_pylist(), found
        ):
            if now != key:
                if rows:
                    yield close()
                key, rows = now, []
            rows.append((c, side, s.values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
    if rows:
        yield close()


PLACE_BITS = 33  # of a row's number within its part, as monotonically_increasing_id gives it


def _marks(places: DataFrame) -> DataFrame:
    """One row for each ``part`` that ``_row`` numbers name, with a bit for every place in it."""

    def run(table):
        place = table["place"].to_numpy()
        bits = np.zeros((int(place.max()) // 64 + 1) * 64, dtype=np.uint8)
        bits[place] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        return pa.table({"part": table["part"].slice(0, 1), "words": pa.array([words], pa.list_(pa.int64()))})

    split = places.select(
        F.shiftright("_row", PLACE_BITS).alias("part"),
        F.col("_row").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"),
    )
    return split.groupBy("part").applyInArrow(run, "part bigint, words array<bigint>")


def _marked(rows: DataFrame, places: DataFrame, inside: bool) -> DataFrame:
    """The ``rows`` whose ``_row`` is among ``places``, or those whose is not, without moving them.

    A bit a row is broadcast, an eighth of a byte however long the texts are.
    """
    place = F.col("_row").bitwiseAND((1 << PLACE_BITS) - 1)
    met = rows.withColumn("part", F.shiftright("_row", PLACE_BITS)).join(F.broadcast(_marks(places)), "part", "left")
    word = F.get("words", (place / 64).cast("int"))
    found = F.coalesce(F.getbit(word, (place % 64).cast("int")), F.lit(0)) == 1
    return met.where(found if inside else ~found).select(*rows.columns)


def _fingerprint_edges(classes: DataFrame) -> DataFrame:
    """Classes whose fingerprints link: each to the least of its fingerprint, and those of near ones."""
    least = classes.groupBy("_fp").agg(F.min("_cls").alias("least"))
    same = classes.join(least, "_fp").where(F.col("_cls") != F.col("least"))
    ends = least.select(F.col("_fp").alias("a"), F.col("least").alias("u"))
    near = (
        simhash.links(least.select(F.col("_fp").alias("fp")))
        .join(ends, "a")
        .join(ends.select(F.col("a").alias("b"), F.col("u").alias("v")), "b")
    )
    return same.select(F.col("_cls").alias("a"), F.col("least").alias("b")).unionByName(
        near.select(F.col("u").alias("a"), F.col("v").alias("b"))
    )


def links(
    rows: DataFrame, text_col: str, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES
) -> DataFrame:
    """Edges ``(a, b)`` that join all classes of similar texts.

    Classes that share a band, or whose SimHash fingerprints link as those of ``simhash``, lie in one
    group, and all pairs of a group are compared, tile against tile, so a group of any size is only
    more tiles. Only the texts that some group wants are moved.
    """
    classes = durable(
        rows.groupBy("_cls").agg(
            F.min("_row").alias("_row"),
            F.first("_n").alias("_n"),
            F.first("_fp").alias("_fp"),
            F.first("_keys").alias("_keys"),
        )
    )
    held = classes.select("_cls", F.explode("_keys").alias("key"))
    # minima combine in the tasks, so a band that many share is one row of each
    least = held.groupBy("key").agg(F.min("_cls").alias("least"), F.max("_cls").alias("most"))
    met = held.join(least.where("least < most"), "key").where(F.col("_cls") != F.col("least"))
    proposed = met.select(F.col("_cls").alias("a"), F.col("least").alias("b")).unionByName(
        _fingerprint_edges(classes.where("_n > 0").select("_cls", "_fp"))
    )
    groups = durable(connected_components(proposed))
    sized = groups.withColumnRenamed("node", "_cls").join(classes.select("_cls", "_row", "_n"), "_cls")
    tiles = sized.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)), F.ceil(F.sum("_n") / F.lit(tile_shingles))
        ).cast("int").alias("tiles")
    )
    wanted = durable(
        sized.join(tiles, "root").select(
            "_cls", "_row", "root", "tiles", F.pmod(F.xxhash64("_cls"), F.col("tiles")).cast("int").alias("tile")
        )
    )

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(found, pa.list_(pa.int64()))],
                names=["root", "tiles", "tile", "_cls", "found"],
            )

    texts = rows.select("_row", F.col(text_col).cast("string").alias("text"))
    sets = (
        _marked(texts, wanted.select("_row"), True)
        .join(wanted, "_row")
        .select("root", "tiles", "tile", "_cls", "text")
        .mapInArrow(run, "root bigint, tiles int, tile int, _cls bigint, found array<bigint>")
    )
    pairs = sets.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return (
        pairs.select(
            "root",
            F.least("tile", "other").alias("first"),
            F.greatest("tile", "other").alias("last"),
            (F.col("tile") > F.col("other")).alias("second"),
            "_cls",
            "found",
        )
        .repartition("root", "first", "last")
        .sortWithinPartitions("root", "first", "last")
        .mapInArrow(_compare, "a bigint, b bigint")
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile_rows: int = TILE_ROWS,
    tile_shingles: int = TILE_SHINGLES,
) -> DataFrame:
    """One row of each group of linked texts, with all columns of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and linked if the sets of
    their five-word shingles have a Jaccard similarity of 0.8 or more; wordless texts are alike.
    The row with the smallest identifier stays, one without an identifier only if its group has
    no other. Rows are told apart by their place, so a repeated identifier removes no other text.
    Null texts count as empty, an empty table gives an empty result, long texts are compared whole,
    and other columns go through whatever their names.
    """
    # by place, so that no name of the table meets one used here
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = _described(plain, text_col)
    roots = connected_components(links(rows, text_col, tile_rows, tile_shingles))
    grouped = rows.select("_row", "_cls", id_col).join(roots.withColumnRenamed("node", "_cls"), "_cls", "left")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))
    kept = grouped.groupBy(F.coalesce("root", "_cls").alias("g")).agg(F.min_by("_row", order).alias("_row"))
    dropped = durable(grouped.select("_row").join(kept, "_row", "left_anti"))
    return _marked(rows, dropped, False).select(*plain.columns).toDF(*docs.columns)
