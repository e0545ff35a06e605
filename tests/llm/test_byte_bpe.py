import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F

from pairlab.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "B", "'s", "'", "12", "é", "日", "\U0001f600", "!", "-", " ", "  ", "\n", "\t", "\xa0", "\x1c", "<|endoftext|>", "ÃÂ"]


@pytest.fixture(scope="module")
def reference():
    """The library that the rank files are made for."""
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_ids_equal_the_reference(reference):
    codec = byte_bpe.Codec(PATH, public_tokenizers.PATTERN, remembered=50)
    texts = odd_texts()
    got = [x.tolist() for part in byte_bpe.slices(texts, 200) for x in codec.encode(part)]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [byte_bpe.decode_ids(codec.tokens, ids) for ids in got] == [t.encode() for t in texts]


def test_query(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)

    def sha(raw):
        return hashlib.sha256(raw).hexdigest()

    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha((d.text or "").encode())


def test_offsets_and_split_characters(spark, reference):
    text = "naïve 日本 \U0001f600\U0001f9ff x"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id bigint, text string")
    r, empty = byte_bpe.encode(df, PATH, with_offsets=True).orderBy("doc_id").collect()
    assert empty.ids == empty.char_start == empty.char_end == []
    at = 0
    for i, a, b in zip(r.ids, r.char_start, r.char_end):
        raw = reference.decode_single_token_bytes(i)
        assert text[a:b].encode().find(raw) >= 0
        assert len(text[:a].encode()) <= at and at + len(raw) <= len(text[:b].encode())
        at += len(raw)
    # one token a row: characters lie in several rows, and meet again
    rows = spark.createDataFrame([(n, [i]) for n, i in enumerate(r.ids)], "doc_id bigint, ids array<int>")
    got = byte_bpe.decode(rows, PATH).orderBy("doc_id").collect()
    assert b"".join(x.decoded for x in got).decode() == text
    assert any(x.lead for x in got) and any(x.trail for x in got)
    assert all(bytes(x.lead) + x.decoded_text.encode() + bytes(x.trail) == bytes(x.decoded) for x in got)


@pytest.mark.parametrize("raw, want", [
    (b"", (b"", b"")), (b"a", (b"", b"")), ("é".encode(), (b"", b"")), ("é".encode()[:1], (b"", b"\xc3")),
    ("é".encode()[1:], (b"\xa9", b"")), ("日".encode()[1:] + b"a" + "😀".encode()[:3], ("日".encode()[1:], "😀".encode()[:3])),
])
def test_cuts(raw, want):
    assert byte_bpe.split_characters(raw) == want


def test_odd_rows(spark, frame, odd, reference):
    got = byte_bpe.digests(frame(odd), PATH).collect()
    want = sorted((r[0] is None, r[0], len(reference.encode_ordinary(r[1] or ""))) for r in odd if r[0] is not None)
    assert sorted((False, r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == want
    assert len(got) == len(odd)
    assert byte_bpe.digests(frame([]), PATH).collect() == []
    clash = frame(odd).withColumns({"ids": F.lit(1), "decoded": F.lit(2), "lead": F.lit("x")})
    assert byte_bpe.decode(byte_bpe.encode(clash, PATH), PATH).count() == len(odd)
    bad = spark.createDataFrame([(1, [-1])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="negative"):
        byte_bpe.decode(bad, PATH).collect()
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).first().decoded == b""
