"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

Every edit of a word is looked up in a broadcast filter of the words of its length; what a filter
holds goes on to a join with the vocabulary itself, which removes the filter's false positives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import durable

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10  # a form occurs at least so many times as often as its variant
HELD_WORDS = 100_000  # words that a task counts before it hands its counts on
WORD_BITS = 24  # bits of a filter for each word
FILTER_BYTES = 8 << 20  # one filter; a length with more words has several
ROUND_BYTES = 32 << 20  # filters broadcast together; more of them are probed in further rounds
PROBE_CELLS = 1 << 20  # edits hashed together
# Odd multipliers of 64-bit mixing.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def vocabulary(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    slip: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word, n``: the words of whole texts of at least ``least_length`` letters that occur ``least_count`` times.

    Words are maximal runs of ``A-Z``, ``a-z`` and U+00C0 to U+00FF; only ``A-Z`` is lower-cased. With
    ``slip`` a run loses a letter where that number divides the CRC-32 of identifier, colon and run:
    letter CRC modulo length. It makes misspellings that do not depend on the order of rows.

    Null and empty texts have no words; a null identifier counts as an empty one. Repeated rows count
    again. Long texts are read whole. An empty table gives an empty vocabulary; other columns are
    ignored. Tasks hand on partial counts, so a frequent word is a row for each task.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def run(batches):
        counts: Counter = Counter()

        def flush():
            words = pa.array(list(counts), pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # bytes have only A-Z to lower
                words = run_of.findall(text.encode().lower().decode())
                if slip:
                    start = crc32(f"{'' if own is None else own}:".encode())
                    for i, word in enumerate(words):
                        h = crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            words[i] = word[:at] + word[at + 1 :]
                    counts.update(w for w in words if len(w) >= least_length)
                else:
                    counts.update(words)
                if len(counts) > HELD_WORDS:
                    yield flush()
        if counts:
            yield flush()

    parts = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [BASE] * (length - 1), dtype=np.uint64), dtype=np.uint64)


def letter_values(codes: np.ndarray) -> np.ndarray:
    return mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


class Shard(NamedTuple):
    """A filter: words of one length whose hash leaves ``part`` of ``parts``, in 64-bit blocks."""

    length: int
    part: int
    parts: int
    blocks: int


def shards_for(sizes: dict[int, int], word_bits: int, filter_bytes: int) -> list[Shard]:
    out = []
    for length, n in sorted(sizes.items()):
        parts = max(1, -(-n * word_bits // (8 * filter_bytes)))
        blocks = max(1, -(-n * word_bits // (64 * parts)))
        out += [Shard(length, part, parts, blocks) for part in range(parts)]
    return out


def rounds_for(shards: list[Shard], round_bytes: int) -> Iterator[list[Shard]]:
    """Filters of at most ``round_bytes`` together, or a single one."""
    held: list[Shard] = []
    for shard in shards:
        if held and 8 * (sum(s.blocks for s in held) + shard.blocks) > round_bytes:
            yield held
            held = []
        held.append(shard)
    if held:
        yield held


def spots(h: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the shard is theirs, the block and the bits of word hashes."""
    h = mixed(h)
    mine = (h >> np.uint64(24)) % np.uint64(shard.parts) == shard.part if shard.parts > 1 else None
    block = ((h >> np.uint64(32)) * np.uint64(shard.blocks)) >> np.uint64(32)
    bits = np.zeros(len(h), dtype=np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return mine, block.astype(np.int64), bits


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), len(words[0]))


def _words(codes: np.ndarray) -> list[str]:
    length, text = codes.shape[1], np.ascontiguousarray(codes, dtype="<u4").tobytes().decode("utf-32-le")
    return [text[i * length : (i + 1) * length] for i in range(len(codes))]


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _fill(shards: list[Shard]):
    """Blocks of the filters, as far as a batch of words sets them."""
    of_length: dict[int, list[int]] = {}
    for i, s in enumerate(shards):
        of_length.setdefault(s.length, []).append(i)

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = []
            for length, at in _by_length(words).items():
                codes = _codes([words[i] for i in at])
                h = (letter_values(codes) * powers(length)).sum(axis=1, dtype=np.uint64)
                for i in of_length.get(length, ()):
                    mine, block, bits = spots(h, shards[i])
                    if mine is not None:
                        block, bits = block[mine], bits[mine]
                    out.append((np.full(len(block), i, dtype=np.int32), block, bits.view(np.int64)))
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "bits"])

    return run


class Prober:
    """Looks up hashes in the filters of a round."""

    def __init__(self, shards: list[Shard], filters: list[np.ndarray]):
        self.of_length: dict[int, list[tuple[Shard, np.ndarray]]] = {}
        for shard, held in zip(shards, filters):
            self.of_length.setdefault(shard.length, []).append((shard, held))

    def hits(self, h: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes that a filter of the length holds."""
        found = []
        for shard, held in self.of_length.get(length, ()):
            mine, block, bits = spots(h, shard)
            hit = (held[block] & bits) == bits
            if mine is not None:
                hit &= mine
            found.append(np.flatnonzero(hit))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def edits(codes: np.ndarray, alphabet: np.ndarray, prober: Prober) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, code points)`` of the edits that a filter holds.

    An edit is a deletion, or a replacement by a higher letter: each pair of near words is proposed
    from one of them, the longer or the one with the lower letter, and once.
    """
    n, length = codes.shape
    place, values = powers(length), letter_values(codes)
    terms = values * place
    whole = terms.sum(axis=1, dtype=np.uint64)
    inverse = np.uint64(pow(BASE, -1, 2**64))
    letters = letter_values(alphabet)
    if length in prober.of_length:
        for i in range(length):
            rows, letter = np.nonzero(alphabet[None, :] > codes[:, i, None])
            h = whole[rows] + (letters[letter] - values[rows, i]) * place[i]
            hit = prober.hits(h, length)
            if len(hit):
                made = codes[rows[hit]].copy()
                made[:, i] = alphabet[letter[hit]]
                yield rows[hit], made
    if length - 1 in prober.of_length:
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        for i in range(length):
            # of equal letters in a row only the first is deleted
            rows = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(n)
            h = before[rows, i] - terms[rows, i] + (whole[rows] - before[rows, i]) * inverse
            hit = prober.hits(h, length - 1)
            if len(hit):
                yield rows[hit], np.delete(codes[rows[hit]], i, axis=1)


def _propose(shards: list[Shard], filters, alphabet: np.ndarray):
    """``word, n, other`` of every word and each of its edits that a filter holds."""

    def run(batches):
        prober = Prober(shards, filters.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            for length, at in _by_length(words).items():
                step = max(1, PROBE_CELLS // max(1, len(alphabet)))
                for lo in range(0, len(at), step):
                    own = at[lo : lo + step]
                    for rows, made in edits(_codes([words[i] for i in own]), alphabet, prober):
                        chosen = own[rows]
                        columns = [pa.array([words[i] for i in chosen]), pa.array(counts[chosen]), pa.array(_words(made))]
                        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "other"])

    return run


def near_pairs(
    words: DataFrame,
    word_bits: int = WORD_BITS,
    filter_bytes: int = FILTER_BYTES,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``word, n, other, other_n``: every pair of distinct ``words`` one edit apart, once.

    Filters have ``word_bits`` bits a word. Those of a round, ``round_bytes`` at most, pass the driver
    and are broadcast; a larger vocabulary takes more rounds, each of which reads the words whose
    edits its lengths can hold.
    """
    spark = words.sparkSession
    sized = words.withColumn("length", F.char_length("word"))
    sizes = {r.length: r.n for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # distinct letters: as many as the alphabet has
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), dtype=np.uint32)
    out = None
    for shards in rounds_for(shards_for(sizes, word_bits, filter_bytes), round_bytes):
        lengths = sorted({s.length for s in shards})
        filled = (
            sized.where(F.col("length").isin(lengths))
            .select("word")
            .mapInArrow(_fill(shards), "shard int, block bigint, bits bigint")
            .groupBy("shard", "block")
            .agg(F.bit_or("bits").alias("bits"))
        )
        filters = [np.zeros(s.blocks, dtype=np.uint64) for s in shards]
        for part in filled.toArrow().to_batches():
            shard, block, bits = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in np.unique(shard):
                filters[i][block[shard == i]] = bits[shard == i].view(np.uint64)
        asking = sized.where(F.col("length").isin(sorted({*lengths, *(n + 1 for n in lengths)})))
        # edits are many times the words, so that a task takes few of them
        proposed = asking.select("word", "n").mapInArrow(
            _propose(shards, spark.sparkContext.broadcast(filters), alphabet), "word string, n bigint, other string"
        )
        out = proposed if out is None else out.unionByName(proposed)
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    if out is None:
        return known.select(F.col("other").alias("word"), F.col("other_n").alias("n"), "other", "other_n")
    return out.join(known, "other").select("word", "n", "other", "other_n")


def group_variants(
    words: DataFrame,
    ratio: int = RATIO,
    word_bits: int = WORD_BITS,
    filter_bytes: int = FILTER_BYTES,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``.

    Two words are near if exactly one inserted, deleted or replaced code point tells them apart. A
    word's ``form`` is its near word of the largest ``n``, of equals the smallest in code-point order,
    if that is at least ``ratio`` times the word's own; else null. ``root`` is the last of the forms of
    forms, the word itself if it has none. ``n_near`` counts near words.

    Null words are left out and repeated ones added up; the empty word is near to all of one letter. An
    empty table gives an empty result; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("forms must occur at least twice as often, or their chains may close")
    words = durable(
        words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    )
    pairs = durable(near_pairs(words, word_bits, filter_bytes, round_bytes))
    turned = pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    # a word has few near words, as few as it has edits
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = pairs.unionByName(turned).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = durable(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form"),
            F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"),
        )
    )
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # each round doubles the steps taken; counts grow by the ratio at each step, so the rounds are few
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(
            links.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        if not links.where("moved").limit(1).collect():
            break
        links = links.select("word", "root")
    return found.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


SQL = """
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lowered AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM runs WHERE length(run) >= 7
), bytes AS (
    SELECT run, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b
    FROM lowered
), hashed AS (
    SELECT run, xor(4294967295, list_reduce(list_concat([4294967295], CAST(b AS BIGINT[])), lambda c, x:
        list_reduce(list_concat([xor(c, x)], range(8)), lambda r, k:
            CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))) AS h
    FROM bytes
), spelt AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed
), words AS (
    SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cuts AS (
    SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other
    FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.head || c.tail = w.word
    UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.head || c.tail = w.word
), best AS (
    SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n
    FROM near JOIN words o ON near.other = o.word GROUP BY near.word
), found AS (
    SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
           CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
    SELECT word, word AS at FROM found
    UNION ALL
    SELECT chain.word, found.form FROM chain JOIN found ON chain.at = found.word WHERE found.form IS NOT NULL
)
SELECT found.word, found.form, chain.at AS root, CAST(found.n AS BIGINT) AS n, found.n_near, CAST(found.form_n AS BIGINT) AS form_n
FROM found JOIN chain ON found.word = chain.word JOIN found last ON chain.at = last.word
WHERE last.form IS NULL
"""
