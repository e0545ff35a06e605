import gzip

import pytest

from pairlab.llm import warc

ROWS = [
    (1, "http://a/1", "<p>same</p>", "x"),
    (5, "http://a/5", "<p>same</p>", "x"),
    (3, None, "<p>same</p>", "x"),
    (7, "http://a/7 \r\nX: y", "other\r\n\r\nWARC/1.1\r\n\r\nbody é 中", "x"),
    (8, "http://a/8", None, "x"),
    (9, "http://a/9", "", "x"),
    (9, "http://a/9", "", "x"),
    (None, "http://a/n", "<p>same</p>", "x"),
    (11, "http://a/11", "long " * 100000, "x"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string, path string").repartition(3)


def facts(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_revisits(pages, least):
    manifest, records = warc.archive_pages(pages, least)
    want, best = [], {}
    for i, _, html, _ in ROWS:
        p = (html or "").encode()
        best.setdefault(p, []).append(-1 if i is None else i)
    seen = set()
    for i, _, html, _ in ROWS:
        p = (html or "").encode()
        top = max(best[p])
        first = len(p) < least or (i == top and p not in seen)
        if i == top:
            seen.add(p)
        want.append((i, len(p), warc.payload_digest(p), "response" if first else "revisit", None if first else top))
    assert facts(records.collect()) == sorted(want, key=str)
    assert manifest.selectExpr("sum(records)").first()[0] == len(ROWS)


def test_files(pages):
    manifest, _ = warc.archive_pages(pages)
    payloads = {}
    for path in [r.path for r in manifest.collect()]:
        records = list(warc.read_records(path))
        raw = gzip.open(path.removeprefix("file://")).read()
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        for r in records:
            assert int(r.headers["Content-Length"]) == len(r.block)
            if r.headers["WARC-Type"] == "response":
                payloads[r.headers["WARC-Record-ID"]] = r
            else:
                assert r.headers["WARC-Profile"] == warc.PROFILE and r.payload == b""
    assert {r.payload.decode() for r in payloads.values()} == {r[2] or "" for r in ROWS}
    for path in [r.path for r in manifest.collect()]:
        for r in warc.read_records(path):
            if r.headers["WARC-Type"] == "revisit":
                assert r.headers["WARC-Refers-To"] in payloads
    urls = {r.headers.get("WARC-Target-URI") for r in payloads.values()}
    assert "http://a/7%20%0D%0AX:%20y" in urls


def test_equal_pages_and_no_pages(spark):
    same = spark.createDataFrame([(4, "u", "x")] * 5, "page_id bigint, url string, html string")
    kinds = [r.record_type for r in warc.archive_pages(same)[1].collect()]
    assert sorted(kinds) == ["response"] + ["revisit"] * 4
    assert warc.archive_pages(same.limit(0))[1].count() == 0


def test_a_cut_archive_is_an_error(pages, tmp_path):
    manifest, _ = warc.archive_pages(pages.coalesce(1))
    path = manifest.first().path.removeprefix("file://")
    cut = tmp_path / "cut.warc.gz"
    cut.write_bytes(open(path, "rb").read()[:-20])
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_records(f"file://{cut}"))
