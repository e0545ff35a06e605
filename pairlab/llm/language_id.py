"""Language identification by the nearest of several clustered centroids per language."""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3)
CENTROIDS = 4  # per language
SAMPLE = 400  # training rows per language whose vectors form the centroids
OVERDRAW = 4
ROUNDS = 12
SLACK = 1.25  # a text is rejected beyond this many times the farthest trained distance of its size
SIZES = (192, 768)  # grams at which a text counts as longer: short ones lie far from any centroid
LEAST_TEXTS = 20  # trained texts of a size that its reach needs
UNDETERMINED = "und"
PIECE = 1 << 18  # characters turned into grams at once


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    languages: list[str]  # of the rows
    reach: np.ndarray  # largest accepted distance (1 - cosine) of texts of each size, short to long


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_FOLD = np.zeros(sys.maxunicode + 1, dtype=np.uint32)


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or 0 for all that is no letter."""
    if not _FOLD[97]:
        for c in range(0x30000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                _FOLD[c] = ord(low) if len(low) == 1 else c
    return _FOLD


def gram_counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed letter n-grams of a whole text; a run of other characters is one blank."""
    counts = np.zeros(dimensions, dtype=np.int64)
    text = text or ""
    fold = _fold_table()
    last = np.zeros(1, dtype=np.uint64)
    for lo in range(0, len(text), PIECE):
        raw = text[lo : lo + PIECE].encode("utf-32-le", "surrogatepass")
        codes = fold[np.frombuffer(raw, dtype=np.uint32)].astype(np.uint64)
        # grams that reach over a cut are counted with the characters before it
        codes = np.concatenate([last, codes])
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        old = len(last) if lo else 1
        counts += _hashed(codes, old if lo else 0, dimensions)
        last = codes[-(max(GRAMS) - 1) :]
    return counts


def _hashed(codes: np.ndarray, old: int, dimensions: int) -> np.ndarray:
    """Gram counts of ``codes`` whose last character lies beyond the first ``old`` ones."""
    out = np.zeros(dimensions, dtype=np.int64)
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n == 1)
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            slot = (mixed >> np.uint64(40)) & np.uint64(dimensions - 1)
            # a gram that starts or ends on a blank is kept: it marks where words begin and end
            out += np.bincount(slot[max(0, old - n + 1) :].astype(np.int64), minlength=dimensions)
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def _held_out(id_col: str) -> F.Column:
    """Rows whose identifier's checksum leaves remainder 1; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _document_frequency(train: DataFrame, dimensions: int) -> tuple[np.ndarray, int]:
    """In how many training texts each slot occurs; a task sends one row for each slot it met."""

    def run(batches):
        total, rows = np.zeros(dimensions, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total += gram_counts(t.as_py(), dimensions) > 0
                rows += 1
        slots = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(np.append(total[slots[:-1]], rows))], names=["slot", "n"]
        )

    df, n = np.zeros(dimensions), 0
    counted = train.select("text").mapInArrow(run, "slot bigint, n bigint")
    for slot, rows in counted.groupBy("slot").agg(F.sum("n")).collect():  # dimensions + 1 rows
        if slot < 0:
            n = rows
        else:
            df[slot] = rows
    return df, n


def _clusters(vectors: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts; returns unit centroids and each row's own."""
    start = [0]
    best = vectors @ vectors[0]
    while len(start) < min(k, len(vectors)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        start.append(far)
        best = np.maximum(best, vectors @ vectors[far])
    centres = vectors[start]
    own = np.zeros(len(vectors), dtype=int)
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[own == i].sum(axis=0) for i in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
    return centres, (vectors @ centres.T).argmax(axis=1)


def fit(
    train: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order_col: str | None = None,
    dimensions: int = DIMENSIONS,
    centroids: int = CENTROIDS,
    sample: int = SAMPLE,
) -> Model:
    """Learn from the rows of ``train`` that have a language and a text with a letter.

    Document frequencies cover all of them. The centroids come from ``sample`` rows per language,
    those with the lowest text hashes; only their vectors reach the driver, ``sample`` times
    ``dimensions`` numbers for each language at most.
    """
    rows = train.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    df, n = _document_frequency(rows, dimensions)
    if not n:
        return Model(np.zeros(dimensions), np.zeros((0, dimensions)), [], np.ones(len(SIZES) + 1))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # A language may hold most rows: only the lowest part of its hashes, about OVERDRAW times the
    # sample, is ranked. There is one row for each language in the broadcast.
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(OVERDRAW * sample)) / F.col("n"))
    low = (
        hashed.select("lang", "h")
        .join(F.broadcast(sizes), "lang")
        .where(F.pmod("h", F.lit(1 << 30)) <= share * (1 << 30))
        .select("lang", "h")
        .distinct()
    )
    pick = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = low.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= sample)
    picked = hashed.join(
        F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi"
    )
    picked = picked.dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def run(batches):
        for batch in batches:
            langs, hs, slots, values = [], [], [], []
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                c = gram_counts(text, dimensions)
                at = np.flatnonzero(c)
                langs.append(lang)
                hs.append(h)
                slots.append(at.astype(np.int32))
                values.append(c[at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(hs, pa.int64()),
                    pa.array(slots, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.int64())),
                ],
                names=["lang", "h", "slots", "counts"],
            )

    table = picked.mapInArrow(run, "lang string, h bigint, slots array<int>, counts array<bigint>")
    by_lang: dict[str, list] = {}
    for r in table.toLocalIterator():
        c = np.zeros(dimensions)
        c[r["slots"]] = r["counts"]
        by_lang.setdefault(r["lang"], []).append((r["h"], _vector(c, idf).astype(np.float32), _size(c)))
    rows_, languages, sizes, distances = [], [], [], []
    for lang in sorted(by_lang):
        vectors = np.stack([v for _, v, _ in sorted(by_lang[lang], key=lambda x: x[0])])
        centres, own = _clusters(vectors, centroids, ROUNDS)
        for i, c in enumerate(centres):
            members = vectors[own == i]
            if len(members):
                rows_.append(c)
                languages.append(lang)
        sizes += [size for _, _, size in sorted(by_lang[lang], key=lambda x: x[0])]
        distances += (1 - (vectors @ centres.T).max(axis=1)).tolist()
    reach = _reach(np.array(sizes), np.array(distances))
    return Model(idf, np.stack(rows_).astype(float), languages, reach)


def _size(counts: np.ndarray) -> int:
    """The place among the sizes of a text with so many grams."""
    return int(np.searchsorted(SIZES, counts.sum(), side="right"))


def _reach(sizes: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Farthest trained distance of each size with its slack; too few texts take that of the shorter size."""
    out, last = [], 1.0
    for size in range(len(SIZES) + 1):
        own = distances[sizes == size]
        if len(own) >= LEAST_TEXTS:
            last = min(1.0, SLACK * float(own.max()))
        out.append(last)
    return np.array(out)


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """Language, cosine to its nearest centroid and whether the text lies beyond the reach of its size.

    Of equally near centroids the first counts, that of the language first in order.
    """
    if not has_letter(text) or not model.languages:
        return UNDETERMINED, 0.0, True
    counts = gram_counts(text, len(model.idf))
    cos = model.centroids @ _vector(counts, model.idf)
    at = int(cos.argmax())
    score = float(min(1.0, max(0.0, cos[at])))
    return model.languages[at], score, bool(1 - score > model.reach[_size(counts)])


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` but these four replace any of the same names.

    ``held_out``, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``: no letter, or farther
    from the nearest centroid than the reach of its size. Null, empty and letterless texts are ``und``
    with score 0 and rejected. Repeated rows and null identifiers come back as they came in. Long
    texts are read whole, and an empty table gives an empty result.
    """
    # One constant for all tasks, sent once to each executor; its size is fixed by the parameters.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def classified(texts: pa.Array) -> pa.Array:
        out = [classify(t.as_py(), shared.value) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([o[0] for o in out], pa.string()),
                pa.array([o[1] for o in out], pa.float64()),
                pa.array([o[2] for o in out], pa.bool_()),
            ],
            names=["lang_pred", "score", "rejected"],
        )

    # Only texts go to Python and only results come back; other columns stay in the JVM.
    new = ("held_out", "lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in new]
    found = classified(F.col(text_col).cast("string"))
    # a name longer than any of the table's
    inner = "_" * (1 + max(map(len, docs.columns))) + "found"
    return docs.select(*kept, _held_out(id_col).alias("held_out"), found.alias(inner)).select(
        *kept, "held_out", *[F.col(inner)[c].alias(c) for c in new[1:]]
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Learn from the rows that are not held out and predict every row; only the text is an input."""
    model = fit(docs.where(~_held_out(id_col)), text_col, lang_col)
    return predict(docs, model, id_col, text_col)
