import base64
import gzip
import hashlib
import uuid
from pathlib import Path

import pytest

from graphloom.llm import warc
from graphloom.llm.common import shared_dir

#: What stands between records in a file.
BORDER = "\r\n\r\nWARC/1.1\r\n"


@pytest.fixture
def pages(spark):
    big = "<p>" + "abc\u00e9\r\n" * 30_000
    rows = [
        (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (3, "http://a/3", "same"), (None, "http://n", "same"), (None, "u", "only null ids"),
        (1, "http://a/1", None), (2, "http://a/ b\r\nX: y", ""), (6, "http://\u00e9/", big), (7, "u", big + "x"), (8, "u", big), (10, "u", "x" + BORDER + "WARC-Type: response" + BORDER), (11, "u", "\r\n\r\n"), (12, "u", "a\r\n"),
    ]
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, bytes int, digest string")


def expected(rows):
    heads = {}
    for r in rows:
        h = (r["html"] or "").encode()
        if r["page_id"] is not None:
            heads[h] = min(heads.get(h, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        h = (r["html"] or "").encode()
        head = heads.get(h)
        revisit = head is not None and r["page_id"] != head
        out.append((r["page_id"], len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [7, 1000, 64 << 10])
def test_round_trip(pages, chunk):
    small = pages.where("length(html) < 1000 OR html IS NULL") if chunk == 7 else pages
    got = sorted(map(tuple, warc.round_trip(small, chunk).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == expected(small.collect())


def test_small_payloads_are_never_revisits(pages):
    got = warc.round_trip(pages, minimum_revisit=100).where("payload_bytes < 100 AND record_type = 'revisit'")
    assert got.count() == 0


def test_archives_and_chunk_rows(spark, pages):
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_archives(pages, path, 1000)
    for f in Path(path).glob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") or not raw
    told = warc.digests(warc.read_chunks(spark, path, 300)).orderBy("record_id", "segment_no", "chunk_no").collect()
    assert max(len(r["chunk"]) for r in told) == 300
    states, sizes = {}, {}
    for r in told:
        h = states.setdefault(r["record_id"], hashlib.sha1())
        h.update(bytes(r["chunk"]))
        sizes[r["record_id"]] = sizes.get(r["record_id"], 0) + len(r["chunk"])
        assert r["digest_so_far"] == base64.b32encode(h.digest()).decode() and r["bytes_so_far"] == sizes[r["record_id"]]


@pytest.mark.parametrize("feed", [1, 7, 4096, 1 << 20])
def test_archive_of_others(feed):
    """Long records in one piece, borders inside payloads, HTTP heads, other record types: rows stay bounded."""
    bodies = [b"", b"x" * 100_000, b"a" + BORDER.encode() * 30 + b"\n\r\n\r\n", bytes(range(256)) * 40]
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for k, body in enumerate(bodies):
        for kind, block in (("text/plain", body), ("application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body)):
            raw += f"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <{k}{kind[:4]}>\r\nContent-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    reader, rows = warc.RecordReader(1000, True), []
    most = 0
    for a in range(0, len(raw), feed):
        reader.feed(raw[a : a + feed], rows)
        most = max(most, len(reader.held))
    reader.close()
    assert most <= 1000 + feed and max(len(r[10]) for r in rows) <= 1000
    for k, body in enumerate(bodies):
        for kind in ("text", "appl"):
            mine = [r for r in rows if r[0] == f"<{k}{kind}>"]
            assert b"".join(r[10] for r in mine) == body and [r[2] for r in mine] == list(range(1, len(mine) + 1))
            assert mine[-1][11:] == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) and [r[9] for r in mine] == [False] * (len(mine) - 1) + [True]
    for part in (raw[:-200], raw[100:]):
        reader = warc.RecordReader(1000, True)
        with pytest.raises(ValueError, match="ends within|no WARC record"):
            reader.feed(part, [])
            reader.close()


def test_damage_is_noticed(spark, pages):
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_archives(pages.where("page_id = 7"), path, 1000)
    f = next(x for x in Path(path).glob("*.gz") if b"abc" in gzip.decompress(x.read_bytes()))
    raw = gzip.decompress(f.read_bytes())
    (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    f.write_bytes(gzip.compress(raw.replace(b"abc", b"abd", 1)))
    with pytest.raises(Exception, match="payload differs"):
        warc.records(warc.read_chunks(spark, path)).collect()


def test_no_pages(pages):
    assert warc.round_trip(pages.where("false")).count() == 0
