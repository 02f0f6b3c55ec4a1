"""WARC archives with segmented records, and reading them back.

Writing: a page becomes a ``response`` record whose block is an HTTP response in chunked transfer
framing. Blocks above a limit are cut into segments: the record itself is segment 1, the
others are ``continuation`` records that name it in ``WARC-Segment-Origin-ID``, and the last one
states the total length. A payload that another page has too is written once, at the page with the largest
id; the others are ``revisit`` records that refer to it.

Reading: records are parsed file by file; segments, which may lie in any files, are grouped by
their origin, ordered by number, checked for gaps and total length, joined, and the chunked
framing is taken off. Every payload is checked against the digest its record states.

Files are written by Spark's text source, whose line separator is the empty lines that end a
WARC record, in gzip, and read as binary files; their size is bounded by a number of records, each
bounded by the segment length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplytics.llm.common import remove, shared_folder, stored

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 1_000
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        chunk = payload[i : i + size]
        parts += [b"%X\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body; chunk extensions and trailer fields are allowed and dropped."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def _uri(url: str | None) -> str | None:
    """A header value holds no line breaks."""
    return None if url is None else "".join(c if c not in "\r\n" else "%0A" for c in url)


def page_records(row: int, page_id: int | None, url: str | None, payload: bytes, refers_row: int | None, refers_to: int | None) -> list[bytes]:
    """The records of one page; ids name its row, so repeated page ids are pages of their own."""
    own = f"<urn:x-page:{row}>"
    fields = [
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_digest(payload)}"),
        ("X-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_row is not None:
        more = [("WARC-Refers-To", f"<urn:x-page:{refers_row}>"), ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", refers_to)]
        return [record([("WARC-Type", "revisit"), *fields, *more], f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        return [record([("WARC-Type", "response"), *fields], block)]
    cuts = range(0, len(block), SEGMENT_BYTES)
    out = [record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:SEGMENT_BYTES])]
    for number, at in enumerate(cuts[1:], 2):
        more = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        if at == cuts[-1]:
            more.append(("WARC-Segment-Total-Length", len(block)))
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page:{row}:{number}>"), ("WARC-Date", DATE)]
        out.append(record([*head, *more], block[at : at + SEGMENT_BYTES]))
    return out


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            values = []
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                values += page_records(*row)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write all rows of ``pages`` (page_id, url, html) to WARC files in ``folder``.

    Equal payloads (by SHA-256, as unlike payloads of one SHA-1 are known) of at least ``min_bytes`` are one response, at the largest page_id (null
    counts as smallest; of repeated rows the first), and revisits of it.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")]
    numbered = stored(pages.select(F.monotonically_increasing_id().alias("row"), *columns), "pages")
    digests = numbered.select("row", "page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    order = F.struct(F.col("page_id").isNotNull(), "page_id", -F.col("row"))
    kept = F.max_by(F.struct("row", "page_id"), order)
    repeated = stored(digests, "digests")
    winners = repeated.groupBy("digest").agg(kept.alias("best"), F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    revisits = (
        repeated.join(winners, "digest")
        .filter(F.col("row") != F.col("best.row"))
        .select("row", F.col("best.row").alias("refers_row"), F.col("best.page_id").alias("refers_to"))
    )
    # Stored, so that its size is known: where few pages repeat, it is small and no page is shuffled.
    revisits = stored(revisits, "revisits")
    rows = numbered.join(revisits, "row", "left").select("row", "page_id", "url", "payload", "refers_row", "refers_to")
    records = rows.mapInArrow(_written, "value binary").select(F.col("value").cast("string"))
    records.write.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder, compression="gzip", lineSep=RECORD_END)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name: value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(fields["Content-Length"])
        if content[at : at + 4] != RECORD_END.encode():
            raise ValueError(f"the record before byte {at} is not as long as it says")
        yield fields, content[start:at]
        at += 4


FIELDS = (
    ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("block", pa.binary()),
)
SCHEMA = (
    "origin string, number int, total long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, block binary"
)


def _payload(block: bytes, digest: str) -> int:
    """Length of the payload in an HTTP response, after the check of its digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" in head.lower():
        body = unchunked(body)
    if base32_digest(body) != digest:
        raise ValueError("a payload differs from its digest")
    return len(body)


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _parsed_record(fields: dict[str, str], block: bytes) -> tuple:
    kind, number = fields["WARC-Type"], _number(fields, "WARC-Segment-Number")
    page_id, refers_to = _number(fields, "X-Page-ID"), _number(fields, "X-Refers-To-Page-ID")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if kind == "continuation":
        return fields["WARC-Segment-Origin-ID"], number, _number(fields, "WARC-Segment-Total-Length"), None, None, None, kind, None, block
    if number is not None:
        return fields["WARC-Record-ID"], number, None, page_id, None, digest, kind, None, block
    if kind == "revisit":
        length = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return None, None, None, page_id, length, digest, kind, refers_to, None
    return None, None, None, page_id, _payload(block, digest), digest, kind, None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in FIELDS])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield _batch([_parsed_record(*r) for r in parse_records(gzip.decompress(content.as_py()))])


def join_segments(group: pa.Table) -> pa.Table:
    """The one record that the segments of an origin make."""
    rows = sorted(group.to_pylist(), key=lambda r: r["number"])
    numbers, total = [r["number"] for r in rows], rows[-1]["total"]
    block = b"".join(r["block"] for r in rows)
    if numbers != list(range(1, len(rows) + 1)) or total is None:
        raise ValueError(f"{rows[0]['origin']}: segments {numbers} are not whole")
    if len(block) != total:
        raise ValueError(f"{rows[0]['origin']}: {len(block)} bytes, {total} are stated")
    first = rows[0]
    length = _payload(block, first["payload_digest"])
    row = (first["page_id"], length, first["payload_digest"], first["record_type"], None)
    types = [t for _, t in FIELDS[3:8]]
    return pa.table([pa.array([v], t) for v, t in zip(row, types)], [name for name, _ in FIELDS[3:8]])


RESULT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    records = stored(content.mapInArrow(_parsed, SCHEMA), "records")
    whole = records.filter("number is null").select(*RESULT)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    joined = records.filter("number is not null").groupBy("origin").applyInArrow(join_segments, schema)
    return whole.unionByName(joined)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and remove them.

    A null html is an empty payload, a null url leaves its header out, a null page_id stays
    null. Repeated rows are pages of their own: all but one are revisits. An empty table gives no
    rows. Further columns are ignored.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages, folder, min_bytes)
    found = read_archive(spark, folder)
    remove(spark, folder)
    return found
