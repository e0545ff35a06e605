"""Best-fit packing of tokenised documents into sequences by large-item matching."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import deque
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.memory import Remembered, slices
from pairlab.session import durable

CAPACITY = 4096
END_ID = 1
REMEMBERED = 200_000  # words of each generation whose ids a Python worker remembers

PIECES = (
    "piece int, start bigint, length bigint, ids_crc32 bigint, _part int, _rank bigint"
)


class Run(NamedTuple):
    """Pieces of one length, ranks ``lo`` to ``hi``: ``per`` of them go to each of the bins from ``bin``."""

    length: int
    lo: int
    hi: int
    bin: int
    per: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Place ``counts[length]`` pieces of every length; the work depends on ``capacity`` alone.

    A piece above a third of the capacity shares its bin with at most one other such piece. They
    are matched greedily: the longest takes the longest partner that fits. The rest, longest first,
    go to the bin with the tightest gap, and to a new bin where none fits. Bins that look alike
    are one group, so millions of pieces are one step.
    """
    runs: list[Run] = []
    used = dict.fromkeys(counts, 0)
    left = {s: n for s, n in counts.items() if n > 0}
    bins = 0
    gaps: dict[int, deque] = {}  # free tokens: groups (first bin, bins)
    order: list[int] = []  # the gaps in use, ascending

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = deque()
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append(Run(length, used[length], used[length] + n, first, per, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    large = sorted(s for s in left if s > third)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if b == a:
            n = left[a] // 2
            if n:
                place(a, 2 * n, bins, 2, 0)
                free(capacity - 2 * a, bins, n)
                bins += n
            if not left[a]:
                large.pop()
                continue
            at -= 1
            b = large[at] if at >= 0 else 0
        n = min(left[a], left[b]) if b else left[a]
        place(a, n, bins, 1, 0)
        if b:
            place(b, n, bins, 1, a)
        free(capacity - a - b, bins, n)
        bins += n
        if b and not left[b]:
            large.pop(at)
        if not left[a]:
            large.pop()
    for s in sorted((s for s in left if s <= third), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                per = capacity // s
                full, rest = divmod(left[s], per)
                if full:
                    place(s, full * per, bins, per, 0)
                    free(capacity - per * s, bins, full)
                    bins += full
                if rest:
                    place(s, rest, bins, rest, 0)
                    free(capacity - rest * s, bins, 1)
                    bins += 1
                continue
            gap = order[at]
            first, n = gaps[gap].popleft()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            per = gap // s
            take = min(n, left[s] // per)
            if take:
                place(s, take * per, first, per, capacity - gap)
                free(gap - per * s, first, take)
            if take < n:
                rest = left[s] if take * per == 0 or left[s] < per else 0
                if rest:
                    place(s, rest, first + take, rest, capacity - gap)
                    free(gap - rest * s, first + take, 1)
                    take += 1
                if take < n:
                    if gap not in gaps:
                        gaps[gap] = deque()
                        bisect.insort(order, gap)
                    gaps[gap].appendleft((first + take, n - take))
    return runs


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    The vocabulary's splitter never joins characters across white space, and parts letters from
    punctuation. So a text's ids are those of its blank-separated parts in order, and a part made of
    Latin letters and then ASCII punctuation is two words. Words and other parts are encoded once and
    remembered while they return.
    """

    LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
    MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    CLOSED = r"(?![^ \t\r\n])"
    WORD = re.compile(f"[{LETTERS}]++(?=[{MARKS}]*+{CLOSED})|[{MARKS}]++{CLOSED}|[^ \t\r\n]+")

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.memory = Remembered(self._learn, remembered)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, dtype=bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)

    def _whole(self, items: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: encoded in one go and cut after each token that ends a word."""
        text = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(text.ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self._whole(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[lo:hi] for lo, hi in zip(at, at[1:])]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        letters, other = [], []
        for word in new:
            (letters if word.isalpha() and max(word) < "\u0100" else other).append(word)
        out = dict(zip(other, self._whole(other)))
        if letters:
            out.update(zip(letters, self._letters(letters)))
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, of texts that lie in memory together."""
        words = [self.WORD.findall(text) for text in texts]
        known = self.memory.resolve({w for ws in words for w in ws})
        return [b"".join(map(known.__getitem__, ws)) for ws in words]


@cache
def _encoder(tokenizer_path: str) -> Encoder:
    """One for each Python worker, which serves one task after another."""
    return Encoder(tokenizer_path)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise whole texts and cut those above ``capacity``; also rank pieces by length in each task."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = _encoder(tokenizer_path).encode
        ranks: dict[int, int] = {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, cols = [], [[] for _ in range(7)]
            parts = slices([t or "" for t in batch.column(1).to_pylist()])
            for at, ids in enumerate(ids for part in parts for ids in encode(part)):
                ids += end
                for k, lo in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * lo : 4 * (lo + capacity)]
                    n = len(own) // 4
                    rank = ranks.get(n, 0)
                    ranks[n] = rank + 1
                    rows.append(at)
                    values = (k, lo, n, zlib.crc32(own), part, rank)
                    if with_ids:
                        values += (np.frombuffer(own, dtype="<u4"),)
                    for c, v in zip(cols, values):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = [id_col, "piece", "start", "length", "ids_crc32", "_part", "_rank"]
            if with_ids:
                arrays.append(pa.array(cols[6], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECES}" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack tokenised documents into sequences of at most ``capacity`` tokens, one row per piece.

    Returns the identifier, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset`` and, on request, the piece's ``ids``. Sequences are filled from offset 0 without
    gaps between pieces.

    A null or empty text is the end token alone. Null identifiers and repeated rows are packed like
    others. An empty table gives an empty result. Other columns are ignored.

    The only data that reaches the driver is the number of pieces of each length, at most
    ``capacity`` numbers. The plan made of it has a few rows for each length, and is joined back
    by length and rank. Ranks are counted in each task and raised by the counts of the tasks
    before, so a length that a third of all pieces have is no hot group.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = docs.sparkSession
    cut = durable(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids))
    by_part = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = by_part.select(
        "length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    placed = spark.createDataFrame(
        plan(counts, capacity), "length bigint, lo bigint, hi bigint, bin bigint, per bigint, at bigint"
    )
    ranked = cut.join(bases, ["length", "_part"]).withColumn("rank", F.col("_rank") + F.col("base"))
    nth = F.col("rank") - F.col("lo")
    return (
        ranked.join(F.broadcast(placed), "length")
        .where("rank >= lo AND rank < hi")
        .select(
            id_col,
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("bin") + F.floor(nth / F.col("per"))).cast("bigint").alias("sequence_id"),
            (F.col("at") + F.col("length") * (nth % F.col("per"))).alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
