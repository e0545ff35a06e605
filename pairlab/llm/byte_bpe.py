"""Byte-level BPE: whole texts to token ids with offsets, and ids back to bytes and text.

The vocabulary is a rank file: a line per token, its bytes in base64 and its rank, which is its id.
The library that encodes works on characters, so bytes are written as characters of an alphabet of
256, and ids turn to bytes again by reversing it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

from pairlab.llm.memory import Remembered, slices

REMEMBERED = 50_000  # words of each generation whose ids a Python worker remembers
# The characters of the White_Space property: Python's blanks without the four information separators.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F)


def read_ranks(path: str) -> list[bytes]:
    """The bytes of every token, in the order of the ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without a gap")
    return [ranks[i] for i in range(len(ranks))]


def byte_alphabet() -> list[str]:
    """A visible character for each byte: its own where it has one, else the next from U+0100 on."""
    own = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def splits(token: bytes, ids: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that joins to ``token``, in order of their ids."""
    pairs = [(token[:i], token[i:]) for i in range(1, len(token))]
    known = [p for p in pairs if p[0] in ids and p[1] in ids]
    return sorted(known, key=lambda p: (ids[p[0]], ids[p[1]]))


def character_offsets(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last character of tokens that end at the bytes ``ends``.

    Characters are those of the UTF-8 text ``raw``. Tokens that share a split character all cover it.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    at = np.cumsum(lead) - 1  # the character that each byte belongs to
    return at[starts], at[ends - 1] + 1


class Codec:
    """Encoder and decoder of one rank file.

    A piece of the split pattern never holds white space after another character, so a text's ids
    are those of its words in order, a word being what is not white space with the white space before
    it. Words are encoded once and remembered while they return.
    """

    WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokens = read_ranks(path)
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        alphabet = byte_alphabet()
        ids = {t: i for i, t in enumerate(self.tokens)}
        spelt = {t: "".join(alphabet[b] for b in t) for t in self.tokens}
        # the rank of a token orders all merges that make it
        merges = [(spelt[a], spelt[b]) for t in self.tokens for a, b in splits(t, ids)]
        self.library = Tokenizer(models.BPE({spelt[t]: i for t, i in ids.items()}, merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.memory = Remembered(self._learn, remembered)

    def _whole(self, text: str) -> np.ndarray:
        encoded = self.library.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(encoded.ids, dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words: those that open and close safely are encoded as one text and cut by bytes."""
        safe, other = [], []
        for w in words:
            (safe if w[0] in WHITE and w[-1] not in WHITE else other).append(w)
        out = {w: self._whole(w).tobytes() for w in other}
        if safe:
            ids = self._whole("".join(safe))
            ends = np.cumsum(self.sizes[ids])
            words_end = np.cumsum([len(w.encode()) for w in safe])
            raw, at = ids.tobytes(), [0, *(4 * (np.searchsorted(ends, words_end) + 1)).tolist()]
            out.update((w, raw[lo:hi]) for w, lo, hi in zip(safe, at, at[1:]))
        return out

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, of texts that lie in memory together."""
        words = [self.WORD.findall(text) for text in texts]
        known = self.memory.resolve({w for ws in words for w in ws})
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype="<i4") for ws in words]


def decode_ids(tokens: list[bytes], ids: Sequence[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 32-bit numbers as one column of lists."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), pa.int32()))


def split_characters(raw: bytes) -> tuple[bytes, bytes]:
    """Bytes at the start and the end that belong to characters cut off there."""
    lo = 0
    while lo < min(3, len(raw)) and raw[lo] & 0xC0 == 0x80:
        lo += 1
    for back in range(1, min(3, len(raw) - lo) + 1):
        byte = raw[-back]
        if byte & 0xC0 != 0x80:
            wanted = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return raw[:lo], raw[len(raw) - back :] if wanted > back else b""
    return raw[:lo], b""


@cache
def _codec(path: str, pattern: str) -> Codec:
    """One for each Python worker, which serves one task after another."""
    return Codec(path, pattern)


@cache
def _tokens(path: str) -> list[bytes]:
    return read_ranks(path)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_offsets: bool = False,
    with_decoded: bool = False,
) -> DataFrame:
    """``id_col`` and ``ids`` of every whole text, and on request ``char_start`` and ``char_end`` of each
    token, or ``decoded``, the bytes that the ids decode to in the same pass.

    Each match of ``pattern`` is encoded separately by the ranks of ``ranks_path``; no string is a
    special token. Offsets count code points; tokens that share a split character all cover it.

    A null or empty text has no ids. Null or repeated identifiers and repeated rows are encoded like
    others; ties do not arise. Long texts are encoded whole. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """

    numbers = T.ArrayType(T.IntegerType())
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", numbers)]
    if with_offsets:
        fields += [T.StructField(n, numbers) for n in ("char_start", "char_end")]
    if with_decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    names = [f.name for f in fields]

    def run(batches):
        codec = _codec(ranks_path, pattern)
        kind = pa.list_(pa.int32())
        for batch in batches:
            at = 0
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                found = codec.encode(texts)
                columns = [batch.column(0).slice(at, len(texts)), _lists(found)]
                if with_offsets:
                    spans = [
                        character_offsets(text.encode(), np.cumsum(codec.sizes[ids])) if len(ids) else (ids, ids)
                        for text, ids in zip(texts, found)
                    ]
                    columns += [pa.array([s[i].astype(np.int32) for s in spans], kind) for i in (0, 1)]
                if with_decoded:
                    raw = [decode_ids(codec.tokens, ids.tolist()) for ids in found]
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)

    schema = T.StructType(fields)
    return docs.select(id_col, F.col(text_col).cast(StringType())).mapInArrow(run, schema)


def decode(
    rows: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    ids_col: str = "ids",
) -> DataFrame:
    """``id_col, ids, decoded, decoded_text, lead, trail`` of every row of ids.

    ``decoded`` holds all bytes. Ids may be cut anywhere, also inside a character: ``lead`` and
    ``trail`` are the bytes of characters cut off at the start and the end, and ``decoded_text`` is
    what lies between, so that the bytes of ``trail`` and of the next row's ``lead`` make one
    character. Bytes within that are no UTF-8 become U+FFFD there.

    Null ids decode like none. An id outside the vocabulary is an error. Identifiers may be null or
    repeated; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        tokens = _tokens(ranks_path)
        for batch in batches:
            raw = [decode_ids(tokens, ids or ()) for ids in batch.column(1).to_pylist()]
            cut = [split_characters(r) for r in raw]
            text = [
                r[len(lead) : len(r) - len(trail)].decode("utf-8", "replace")
                for r, (lead, trail) in zip(raw, cut)
            ]
            columns = [
                *batch.columns,
                pa.array(raw, pa.binary()),
                pa.array(text, pa.string()),
                pa.array([c[0] for c in cut], pa.binary()),
                pa.array([c[1] for c in cut], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=[id_col, "ids", "decoded", "decoded_text", "lead", "trail"]
            )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, ids array<int>, decoded binary, decoded_text string, lead binary, trail binary"
    )
    # a negative number would count from the vocabulary's end
    sound = F.expr(f"transform(`{ids_col}`, x -> if(x >= 0, x, raise_error('a token id is negative')))")
    return rows.select(id_col, sound.cast("array<int>").alias("ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: texts encoded, and the ids decoded again."""
    back = encode(docs, ranks_path, with_decoded=True)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
