"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.components import connected_components
from pairlab.session import durable

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
TILE_ROWS = 4096
PARTS = 4  # a fingerprint's population count is taken in this many 16-bit parts
CHUNK = 1 << 21  # matrix cells compared at once


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text as a signed 64-bit number; null and wordless texts give zero."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)`` of every row, null identifiers included."""

    def run(batches):
        for batch in batches:
            fp = [simhash(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, fp bigint"
    )


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps between part counts that may lie within the radius, one of each pair of opposites."""
    span = range(-radius, radius + 1)
    return [
        o
        for o in product(span, repeat=PARTS)
        if sum(map(abs, o)) <= radius and o > (0,) * PARTS
    ]


def _cell(counts) -> F.Column:
    """One number for the population counts of the parts; base 32 leaves room for steps outside."""
    out = F.lit(0)
    for c in counts:
        out = out * 32 + c + 8
    return out.cast("int")


def _compare(radius: int):
    """Compare each tile's own rows with one another and with the rows that visit the tile.

    Rows arrive sorted by tile with its own rows first. Matches within a tile are merged on the
    spot, so a tile emits at most one edge for each of its rows and visitors, however many pairs
    match; this keeps every link between different texts in the components.
    """

    def run(batches):
        key, home, parent = None, [], None
        out_a, out_b = [], []

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def merge(i, j):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)

        def match(rows, inside):
            """Edges between ``rows`` and the open tile; merges the tile's rows that they join."""
            step = max(1, CHUNK // max(1, len(home)))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                near = np.bitwise_count(part[:, None] ^ home[None, :]) <= radius
                at, own = np.nonzero(near)
                if inside:
                    at = at + lo
                    later = own > at
                    pairs = zip(at[later].tolist(), own[later].tolist())
                elif len(at):
                    first = near.argmax(axis=1)
                    met = np.unique(at)
                    out_a.extend(part[met])
                    out_b.extend(home[first[met]])
                    pairs = np.unique(np.stack([first[at], own], axis=1), axis=0).tolist()
                else:
                    continue
                for i, j in pairs:
                    merge(i, j)

        def close():
            for i in range(len(home)):
                r = find(i)
                if r != i:
                    out_a.append(home[i])
                    out_b.append(home[r])

        def flush():
            a = np.array(out_a, dtype=np.uint64).view(np.int64)
            b = np.array(out_b, dtype=np.uint64).view(np.int64)
            out_a.clear()
            out_b.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        opened = True
        for batch in batches:
            cell, tile, visits, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            group = cell.astype(np.int64) << 32 | tile
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (visits[1:] != visits[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
                if group[lo] != key:
                    if not opened:
                        match(home, True)
                    if key is not None:
                        close()
                    key, home, opened = group[lo], np.empty(0, np.uint64), False
                    parent = []
                if not visits[lo]:
                    home = np.concatenate([home, fp[lo:hi]])
                    parent = list(range(len(home)))
                    continue
                if not opened:
                    match(home, True)
                    opened = True
                if len(home):
                    match(fp[lo:hi], False)
            if out_a:
                yield flush()
        if key is not None:
            if not opened:
                match(home, True)
            close()
        if out_a:
            yield flush()

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that join all distinct fingerprints ``fp`` within ``radius`` bits.

    Fingerprints lie in cells by the population counts of their 16-bit parts, and a cell is cut
    into tiles of about ``tile_rows``. If two fingerprints differ in at most ``radius`` bits, their
    part counts differ by at most ``radius`` in sum, so all other pairs of tiles are skipped
    unseen. A row visits the tiles of half of its cell's neighbours, and the lower tiles of its own
    cell: every pair meets exactly once. A cell of any size is only more tiles, each one task's
    bounded memory.
    """
    counts = [
        F.expr(f"cast(bit_count(shiftrightunsigned(fp, {16 * i}) & 65535L) as int)")
        for i in range(PARTS)
    ]
    placed = distinct.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    parts = [F.col(f"c{i}") for i in range(PARTS)]
    placed = placed.select("fp", *parts, _cell(parts).alias("cell"))
    # At most 17 ** PARTS cells exist, whatever the number of rows.
    cells = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("tiles")
    )
    cells = F.broadcast(cells)
    own = placed.join(cells, "cell").withColumn(
        "tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    )
    homes = own.select("cell", "tile", F.lit(False).alias("visits"), "fp")
    lower = own.where("tile > 0").select(
        "cell", F.explode(F.expr("sequence(0, tile - 1)")).alias("tile"), F.lit(True).alias("visits"), "fp"
    )
    targets = F.array(
        *[_cell([p + s for p, s in zip(parts, step, strict=True)]) for step in _offsets(radius)]
    )
    visitors = (
        placed.select("fp", F.explode(targets).alias("cell"))
        .join(cells, "cell")
        .select(
            "cell",
            F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"),
            F.lit(True).alias("visits"),
            "fp",
        )
    )
    return (
        homes.unionByName(lower)
        .unionByName(visitors)
        .repartition("cell", "tile")
        .sortWithinPartitions("cell", "tile", "visits")
        .mapInArrow(_compare(radius), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: identifier, ``fingerprint``, ``component_id``, ``group_fingerprint``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and hashed in shingles of
    three words. Documents are linked if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest identifier reachable by links.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated
    rows come back as often as they came in. A null identifier never names a component: a
    component that holds no other has a null ``component_id``. Other columns are ignored. An empty
    table gives an empty result. Copies share a fingerprint and are compared once.
    """
    prints = durable(fingerprints(docs, id_col, text_col))
    classes = durable(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(links(classes.select("fp"), radius, tile_rows))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    grouped = durable(grouped)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "root", "component_id")

    def digits(name: str) -> F.Column:
        return F.lower(F.lpad(F.hex(name), 16, "0"))

    return prints.join(named, "fp").select(
        id_col,
        digits("fp").alias("fingerprint"),
        "component_id",
        digits("root").alias("group_fingerprint"),
    )


def keep_one(
    docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, with all columns of ``docs``.

    The row whose identifier is the component's stays; rows that repeat it are one row. A
    component whose identifiers are all null keeps one of its rows.
    """
    found = durable(near_duplicates(docs, radius, id_col=id_col, text_col=text_col))
    kept = found.where(F.col("component_id") == F.col(id_col)).select(id_col).distinct()
    named = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col])
    bare = found.where(F.col(id_col).isNull() & F.col("component_id").isNull())
    # Only rows without an identifier are fingerprinted again, next to their text.
    tagged = _with_fingerprint(docs.where(F.col(id_col).isNull()), text_col)
    bare = tagged.join(
        bare.select(
            F.conv("fingerprint", 16, -10).cast("bigint").alias("_fp"),
            F.col("group_fingerprint").alias("_group"),
        ).distinct(),
        "_fp",
    ).dropDuplicates(["_group"])
    return named.select(*docs.columns).unionByName(bare.select(*docs.columns))


def _with_fingerprint(docs: DataFrame, text_col: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            fp = [simhash(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fp, pa.int64())], names=[*batch.schema.names, "_fp"]
            )

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_fp", LongType())]))
