"""WARC archives as a chunked record table.

Writing: each page is a ``response`` record, or a ``revisit`` of the page with the smallest id among equal payloads. A payload is never copied
as a whole: its SHA-1 state is carried from chunk to chunk of at most ``chunk_bytes``, and a payload of several chunks is
cut into WARC segments (a first record and ``continuation`` records), each a row of its own. The archives are plain WARC files: records
joined by CRLF CRLF, written through Spark's text sink and so with its commit protocol on any file system, one gzip
stream per file of at most ``file_records`` rows.

Reading: a task reads its files line by line and cuts records by their Content-Length into rows of record identifier, segment,
chunk number, and bytes and SHA-1 of the payload up to and with that chunk. It holds a line, a batch of lines and a chunk, whatever a record's size, also of archives that
others wrote: long records in one piece, payloads that hold the border of a record, HTTP heads before the payload. Segments may lie in several
files; ``digests`` carries their states on in the order of the segments.

A gzip stream cannot be split, so a file is one task's work; a file without compression that was split stops the job.

Defined results: null html is an empty payload; a null url is written without a target; a page id that repeats gives a
record per row, and equal payloads under the smallest id are responses all; where all ids of equal payloads are null, all are responses;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import small_side
from .common import shared_dir, stored

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, segment_no long, chunk_no long, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "whole boolean, last boolean, chunk binary, bytes_so_far long, digest_so_far string"
)
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CHUNKS.split(", "))])


def base32(state) -> str:
    return base64.b32encode(state.digest()).decode()


def _views(payload, chunk_bytes: int) -> Iterator[memoryview]:
    """Chunks of a buffer, not copied; of an empty one, one."""
    view = memoryview(payload)
    for a in range(0, max(1, len(view)), chunk_bytes):
        yield view[a : a + chunk_bytes]


def carried_digest(payload, chunk_bytes: int) -> str:
    """The SHA-1 (bare base32) of a payload, its state carried from chunk to chunk."""
    state = hashlib.sha1()
    for view in _views(payload, chunk_bytes):
        state.update(view)
    return base32(state)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = 64 << 10, minimum_revisit: int = 0, file_records: int = 1_000_000) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files below ``path``. Equal payloads are told by the same
    digest, computed where they are read; they stay there, unless there are too many repeated ones to send their names to each task."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    named = read.withColumns({"name": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    heads = named.where(F.col("bytes") >= minimum_revisit).groupBy("name").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = stored(heads.where("copies > 1 AND head IS NOT NULL").select("name", "head"), "heads")
    told = named.join(small_side(heads), "name", "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")) & (F.col("bytes") >= minimum_revisit)
    told = told.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "name", "bytes", F.when(revisit, F.col("head")).alias("head"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes] = []
            held = 0
            for page, url, payload, name, size, head in zip(*(batch.column(k) for k in range(6)), strict=True):
                digest = carried_digest(payload.as_buffer(), chunk_bytes) if head.as_py() is None else base64.b32encode(bytes.fromhex(name.as_py())).decode()
                for row in _segments(page.as_py(), url.as_py(), payload, digest, size.as_py(), head.as_py(), chunk_bytes):
                    rows.append(row)
                    held += len(row)
                    if held > 8 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    lines = told.mapInArrow(segments, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _segments(page: int | None, url: str | None, payload: pa.Scalar, digest: str, size: int, head: int | None, chunk_bytes: int) -> Iterator[bytes]:
    """The segments of a response, each with its header block, or the one record of a revisit."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [f"WARC-Type: {'response' if head is None else 'revisit'}", f"WARC-Record-ID: {name}", "Content-Type: text/html", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", "%20", url))
    fields.append(f"X-Payload-Length: {size}")
    if page is not None:
        fields.append(f"X-Page-ID: {page}")
    if head is not None:
        yield _block([*fields, f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page-ID: {head}"], b"")
        return
    if size > chunk_bytes:
        fields.append("WARC-Segment-Number: 1")
    written = 0
    for k, view in enumerate(_views(payload.as_buffer(), chunk_bytes), 1):
        written += len(view)
        if k > 1:
            fields = ["WARC-Type: continuation", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Segment-Origin-ID: {name}", f"WARC-Segment-Number: {k}"]
            if written == size:
                fields.append(f"WARC-Segment-Total-Length: {size}")
        yield _block(fields, view)


def _block(fields: list[str], content) -> bytes:
    head = CRLF.join(["WARC/1.1", *fields, f"Content-Length: {len(content)}", "", ""]).encode("utf-8", "surrogatepass")
    return b"".join((head, content))


class RecordReader:
    """Cuts a stream of bytes into chunk rows; what comes in is released as soon as it is told."""

    def __init__(self, chunk_bytes: int, keep: bool):
        self.chunk_bytes, self.keep = chunk_bytes, keep
        self.held = bytearray()
        #: Of the record that is being read: header fields, bytes that are left, whether an HTTP head comes first.
        self.fields: dict[str, str] | None = None
        self.left, self.http = 0, False

    def feed(self, data: bytes, rows: list[tuple]) -> None:
        self.held += data
        at = 0
        while True:
            if self.fields is None:
                while at < len(self.held) and self.held[at] in b"\r\n":
                    at += 1
                end = self.held.find(b"\r\n\r\n", at)
                if end < 0:
                    if not self.held.startswith(b"WARC/"[: len(self.held) - at], at) or len(self.held) - at > 1 << 20:
                        raise ValueError("no WARC record starts here: the archive is damaged, or a file without compression was split")
                    break
                self._open(bytes(self.held[at:end]))
                at = end + 4
            if self.http:
                end = self.held.find(b"\r\n\r\n", at, at + self.left)
                if end < 0 and len(self.held) - at < self.left:
                    break
                passed = end + 4 - at if end >= 0 else self.left
                at, self.left, self.http = at + passed, self.left - passed, False
            have = min(self.left, len(self.held) - at)
            while have >= self.chunk_bytes or have == self.left:
                n = min(have, self.chunk_bytes)
                rows.append(self._row(bytes(self.held[at : at + n]), n == self.left))
                at, have, self.left = at + n, have - n, self.left - n
                if not self.left:
                    self.fields = None
                    break
            if self.fields is not None:
                break
        del self.held[:at]

    def _open(self, head: bytes) -> None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record starts here: the archive is damaged, or a file without compression was split")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left = int(self.fields["content-length"])
        self.http = self.fields.get("content-type", "").startswith("application/http") and self.fields.get("warc-type") in ("response", "revisit")
        self.number, self.size, self.state = 0, 0, hashlib.sha1()

    def _row(self, chunk: bytes, last: bool) -> tuple:
        get = self.fields.get
        number = lambda name: int(get(name)) if get(name) else None
        self.number += 1
        self.size += len(chunk)
        self.state.update(chunk)
        segment = number("warc-segment-number")
        return (
            get("warc-segment-origin-id") or get("warc-record-id"), segment or 1, self.number, number("x-page-id"), get("warc-type"),
            get("warc-payload-digest", "").removeprefix("sha1:") or None, number("x-payload-length"), number("x-refers-to-page-id"),
            segment is None, last, chunk if self.keep or segment else None, self.size, base32(self.state) if segment is None else None,
        )

    def close(self) -> None:
        if self.fields is not None or bytes(self.held).strip():
            raise ValueError(f"the archive ends within record {(self.fields or {}).get('warc-record-id')}")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = 64 << 10, keep: bool = True) -> DataFrame:
    """A row of CHUNKS for each chunk of each record. Of segments, bytes are told within the segment and digests not yet. Without ``keep``,
    chunks of records in one piece are left out once they are digested."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = RecordReader(chunk_bytes, keep), [], 0
        for batch in batches:
            lines = batch.column(0).to_pylist()
            lines.append(b"")
            done = len(rows)
            reader.feed(b"\n".join(lines), rows)
            held += sum(len(r[10]) for r in rows[done:] if r[10])
            if len(rows) >= 5000 or held > 16 * chunk_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                rows, held = [], 0
        reader.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary")).mapInArrow(task, CHUNKS)


def digests(chunks: DataFrame) -> DataFrame:
    """Carries bytes and SHA-1 over the segments of each record; chunks of one record are visited in order by one task with a running
    state, and at most a batch of chunks is held."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, size, at = None, None, 0, (0, True)
        for batch in batches:
            sizes, sums = [], []
            for record, no, part, last, chunk in zip(*(batch.column(n).to_pylist() for n in ("record_id", "segment_no", "chunk_no", "last")), batch.column("chunk"), strict=True):
                if record != name:
                    name, state, size, at = record, hashlib.sha1(), 0, (0, True)
                if no != at[0] + (part == 1) or (part == 1) != at[1]:
                    raise ValueError(f"record {name} lacks its segment {at[0] + 1}")
                at = (no, last)
                state.update(chunk.as_buffer())
                size += len(chunk.as_buffer())
                sizes.append(size)
                sums.append(base32(state.copy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], batch.schema.names)

    several = chunks.where("NOT whole").repartition("record_id").sortWithinPartitions("record_id", "segment_no", "chunk_no").mapInArrow(carry, CHUNKS)
    return chunks.where("whole").unionByName(several)


def records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit; bytes and digest of responses come from the bytes that were
    read and must be those of the header, where it tells any."""
    told = ["page_id", "payload_digest", "payload_bytes", "refers_to"]
    read = digests(chunks).drop("chunk")
    several = read.where("NOT whole").groupBy("record_id").agg(*[F.max(c).alias(c) for c in told], F.lit("response").alias("record_type"), F.max("bytes_so_far").alias("bytes_so_far"), F.max_by("digest_so_far", F.struct("segment_no", "chunk_no")).alias("digest_so_far"))
    names = [*told, "record_type", "bytes_so_far", "digest_so_far"]
    both = read.where("whole AND last AND record_type IN ('response', 'revisit')").select(names).unionByName(several.select(names))
    response = F.col("record_type") == "response"
    wrong = response & ((F.col("digest_so_far") != F.col("payload_digest")) | (F.col("bytes_so_far") != F.col("payload_bytes")))
    size = F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its header: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")))).cast("long")).otherwise(size)
    return both.select("page_id", checked.alias("payload_bytes"), F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, chunk_bytes: int = 64 << 10, minimum_revisit: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads their records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path, chunk_bytes, minimum_revisit)
    return records(read_chunks(spark, path, chunk_bytes, keep=False))
