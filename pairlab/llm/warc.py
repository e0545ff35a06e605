"""Web archives: write records, resolve revisits by payload digest, write deduplicated archives."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.session import durable, durable_root

# The archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT = "application/http; msgtype=response"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("7f9c2ba4-e88f-5827-9b1a-2a1c5f7d3e60")
CHUNK = 1 << 20
LEVEL = 6
MIN_PAYLOAD = 0

MANIFEST = "path string, records bigint"
HEADERS = (
    "path string, ordinal bigint, record_id string, record_type string, url string, page_id bigint,"
    " payload_bytes bigint, payload_digest string, refers_to_record string"
)


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes  # all behind the headers

    @property
    def payload(self) -> bytes:
        """The page behind the HTTP headers."""
        return self.block.partition(b"\r\n\r\n")[2]


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(url: str) -> str:
    """A header value holds no control characters; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def encode(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items() if v is not None)]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def decode(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not an archive record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) < size + 4:
        raise ValueError("an archive record is cut short")
    return Record(headers, rest[:size])


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def read_records(path: str) -> Iterator[Record]:
    """The records of one archive in order; one is held at a time."""
    with _open(path) as source:
        raw, member, text = source.read(CHUNK), zlib.decompressobj(31), []
        while raw:
            text.append(member.decompress(raw))
            raw = member.unused_data
            if member.eof:
                yield decode(b"".join(text))
                member, text = zlib.decompressobj(31), []
            raw = raw or source.read(CHUNK)
        if text:
            raise ValueError(f"{path} ends within a record")


class _Writer:
    """One archive file. It gets its name when it is complete, so a lost task leaves no half file."""

    def __init__(self, path: str):
        self.system, self.path = fs.FileSystem.from_uri(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.open_path = f"{self.path}.{uuid.uuid4().hex}.open"
        self.stream = self.system.open_output_stream(self.open_path, compression=None)
        self.records = 0

    def write(self, record: bytes):
        self.stream.write(record)
        self.records += 1

    def close(self):
        self.stream.close()
        # Another attempt of the same task writes the same records.
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)
        self.system.move(self.open_path, self.path)

    def drop(self):
        self.stream.close()
        self.system.delete_file(self.open_path)


def _folder(spark: SparkSession, name: str) -> str:
    root = durable_root(spark)
    root = re.sub(r"^file:/+", "file:///", root if ":/" in root else f"file://{root}")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _response(name: str, ordinal: int, page_id, url, payload: bytes) -> bytes:
    key = f"{name}:{ordinal}:{page_id}"
    return encode(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMES, key)}>",
            "WARC-Date": DATE,
            "WARC-Target-URI": None if url is None else _plain(url),
            "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
            "X-Page-ID": None if page_id is None else str(page_id),
            "Content-Type": CONTENT,
        },
        HTTP.format(len(payload)).encode() + payload,
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a response record per row, an archive per task; returns the ``(path, records)`` written."""
    target = folder or _folder(pages.sparkSession, "archives")

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        writer = None
        try:
            for batch in batches:
                for page, url, html in zip(*batch.columns):
                    writer = writer or _Writer(f"{target}/{name}")
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    writer.write(_response(name, writer.records, page.as_py(), url.as_py(), payload))
        except BaseException:
            if writer:
                writer.drop()
            raise
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{target}/{name}"]), pa.array([writer.records], pa.int64())],
                names=["path", "records"],
            )

    chosen = pages.select(
        F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")
    )
    return durable(chosen.mapInArrow(run, MANIFEST))


def _dealt(manifest: DataFrame) -> DataFrame:
    """Archives dealt to tasks by path, about one each."""
    return manifest.select("path").repartition(max(1, manifest.count()), "path")


def read_headers(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives, without payloads; digests are taken from the payloads."""

    def rows(path):
        for at, r in enumerate(read_records(path)):
            h = r.headers
            kind = h["WARC-Type"]
            page = h.get("X-Page-ID")
            payload = r.payload
            digest = payload_digest(payload) if kind == "response" else h["WARC-Payload-Digest"].partition(":")[2]
            yield (
                path, at, h["WARC-Record-ID"], kind, h.get("WARC-Target-URI"),
                None if page is None else int(page), len(payload) if kind == "response" else None,
                digest, h.get("WARC-Refers-To"),
            )

    def batch_of(rows_):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in HEADERS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_), kinds)], names=names)

    def run(batches):
        held = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    if len(held) == 4096:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return _dealt(manifest).mapInArrow(run, HEADERS)


def resolve_revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Which records stay responses: ``(path, ordinal, original, page_id, url)``.

    Of the records whose payloads are equal and have at least ``min_payload`` bytes, the one with
    the largest page number is the original; null numbers come last, and ties go to the first
    place. ``original`` is null for responses, and the original's record for revisits. Only headers
    are shuffled, with minima and maxima combined on the map side.
    """
    key = ["payload_digest", "payload_bytes"]
    able = headers.where(F.col("payload_bytes") >= min_payload)
    rank = F.struct(F.col("page_id"), F.col("record_id"))
    best = able.groupBy(*key).agg(
        F.max(rank).alias("best"), F.max_by("url", rank).alias("best_url"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    joined = headers.join(best, key, "left")
    revisit = F.col("best").isNotNull() & (F.col("best.record_id") != F.col("record_id"))
    return joined.select(
        "path",
        "ordinal",
        F.when(revisit, F.col("best.record_id")).alias("original"),
        F.when(revisit, F.col("best_url")).alias("original_url"),
    )


def write_deduplicated(
    manifest: DataFrame, decisions: DataFrame, folder: str | None = None
) -> DataFrame:
    """Copy the archives with fresh headers; revisits lose their payloads. Returns the new manifest.

    Decisions meet their archive by its path, so payloads are never shuffled.
    """
    target = folder or _folder(manifest.sparkSession, "archives")

    def copy(path, decided):
        name = path.rpartition("/")[2]
        writer = _Writer(f"{target}/{name}")
        try:
            for at, record in enumerate(read_records(path)):
                ordinal, original, url = next(decided)
                if ordinal != at:
                    raise ValueError(f"{path} has other records than its decisions")
                h = record.headers
                fresh = {
                    "WARC-Type": "revisit" if original else "response",
                    "WARC-Record-ID": h["WARC-Record-ID"],
                    "WARC-Date": h["WARC-Date"],
                    "WARC-Target-URI": h.get("WARC-Target-URI"),
                    "WARC-Payload-Digest": h["WARC-Payload-Digest"],
                    "WARC-Profile": PROFILE if original else None,
                    "WARC-Refers-To": original,
                    "WARC-Refers-To-Target-URI": url,
                    "X-Page-ID": h.get("X-Page-ID"),
                    "Content-Type": CONTENT,
                }
                block = record.block
                if original:
                    block = block[: len(block) - len(record.payload)]
                writer.write(encode(fresh, block))
        except BaseException:
            writer.drop()
            raise
        writer.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{target}/{name}"]), pa.array([writer.records], pa.int64())],
            names=["path", "records"],
        )

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            path = row[0]

            def decided():
                nonlocal row
                while row is not None and row[0] == path:
                    yield row[1:]
                    row = next(rows, None)

            mine = decided()
            yield copy(path, mine)
            if next(mine, None) is not None:
                raise ValueError(f"{path} has fewer records than its decisions")

    dealt = decisions.select("path", "ordinal", "original", "original_url").repartition(
        max(1, manifest.count()), "path"
    )
    return durable(dealt.sortWithinPartitions("path", "ordinal").mapInArrow(run, MANIFEST))


def archive_pages(
    pages: DataFrame,
    min_payload: int = MIN_PAYLOAD,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> tuple[DataFrame, DataFrame]:
    """``(manifest, records)`` of the deduplicated archives of ``pages``, read back from their files.

    ``records`` has ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``; a
    revisit's payload is its original's. A null or empty page has an empty payload; null numbers and
    addresses are left out of the headers and come back null. Repeated rows are records of their own.
    An empty table writes no archive. Other columns are ignored.
    """
    first = write_archives(pages, None, id_col, url_col, html_col)
    decisions = resolve_revisits(durable(read_headers(first)), min_payload)
    manifest = write_deduplicated(first, decisions)
    headers = durable(read_headers(manifest))
    original = headers.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("original_bytes"),
    )
    revisits = headers.where("record_type = 'revisit'").join(original, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    records = (
        headers.where("record_type = 'response'")
        .withColumn("refers_to", F.lit(None).cast("bigint"))
        .select(*columns)
        .unionByName(revisits.withColumn("payload_bytes", F.col("original_bytes")).select(*columns))
    )
    return manifest, records
