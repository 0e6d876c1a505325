"""WARC records in seekable Zstandard bundles, with an index from record to frame-relative offset.

Records are grouped into frames that decompress on their own; a bundle is a run of frames and a
footer seek table in a skippable frame (the public seekable format).  Bundles are rows of a table in
the shared folder, each with the index of its records, so that one record is read by decompressing
one frame.  Pages with equal payloads are stored once; the others become revisit records.  A record's id
names its page and its payload, so pages of one page_id that differ have ids of their own.

Edge cases, all defined: a null html is an empty payload (a response); a null url is ``urn:unknown``
and control characters in a url are percent-encoded; in a group of equal payloads rows that repeat
the largest page_id are all responses; a null page_id loses to any other and, alone in its group, is
a response; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stored

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE_SCHEMA = "bundle_id string, data binary, n_frames int, index array<struct<page_id: bigint, record_id: string, frame: int, offset: int, length: int>>"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, decompressed) sizes of all frames in a skippable frame."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame."""
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the bundle")
    at, start, out = len(data) - 9 - 8 * n, 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", data, at + 8 * i)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(data: bytes, seek: list[tuple[int, int, int]], frame: int) -> bytes:
    start, packed, plain = seek[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)


def _clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"


def record_id_of(page_id: int | None, digest: str) -> str:
    """``<urn:page:PAGE:DIGEST>`` with the first 64 bits of the payload's SHA-1; no page number for a null page_id."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(record id, bytes) of a response record, or of a revisit one where ``refers_to`` is given.

    The record's block is an HTTP head, which tells the payload's length, and for a response the payload.
    """
    record_id = record_id_of(page_id, digest)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean_url(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id_of(refers_to, digest)}"]
    return record_id, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, block, payload and its stated length of one record; a response's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    return {"headers": headers, "payload": payload, "payload_bytes": length, "payload_digest": digest}


def page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]{16}>", record_id or "")
    return int(found[1]) if found else None


def plan_records(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and ``refers_to`` (null: a response) of every page.

    Only groups that have several pages are joined back; the join is on the digest alone, so that
    Spark can split the rows of one very common payload over tasks.
    """
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    groups = base.where(F.length("payload") >= revisit_bytes).groupBy("digest", F.length("payload").alias("group_bytes")).agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and winner is not null").select(F.col("digest").alias("group_digest"), "group_bytes", "winner")
    out = base.join(groups, (F.col("digest") == F.col("group_digest")) & (F.length("payload") == F.col("group_bytes")), "left")
    refers = F.when(F.col("winner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("winner"))), F.col("winner"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_bundles(records: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 4 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles as rows, streamed: a task holds one frame and one bundle at a time."""
    arrow = arrow_schema(BUNDLE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=level)
        data, frames, index, frame = bytearray(), [], [], bytearray()

        def end_frame() -> None:
            if frame:
                packed = packer.compress(bytes(frame))
                frames.append((len(packed), len(frame)))
                data.extend(packed)
                frame.clear()

        def end_bundle() -> Iterator[pa.RecordBatch]:
            nonlocal number
            end_frame()
            if frames:
                row = {"bundle_id": f"{task:06d}-{number:06d}", "data": bytes(data) + seek_table(frames), "n_frames": len(frames), "index": list(index)}
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=arrow)
                data.clear(), frames.clear(), index.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in ("page_id", "url", "payload", "digest", "refers_to"))
                record_id, raw = format_record(page, url, payload, digest, refers, date)
                index.append({"page_id": page, "record_id": record_id, "frame": len(frames), "offset": len(frame), "length": len(raw)})
                frame.extend(raw)
                if len(frame) >= frame_bytes:
                    end_frame()
                if len(data) >= bundle_bytes:
                    yield from end_bundle()
        yield from end_bundle()

    return records.mapInArrow(run, BUNDLE_SCHEMA)


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles by way of their indexes: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, index = batch.column("data")[i].as_py(), batch.column("index")[i].as_py()
                seek, at, plain, rows = read_seek_table(data), -1, b"", []
                for x in index:
                    if x["frame"] != at:
                        at, plain = x["frame"], read_frame(data, seek, x["frame"])
                    record = parse_record(plain[x["offset"] : x["offset"] + x["length"]])
                    headers = record["headers"]
                    row = {"page_id": page_of(headers["warc-record-id"]), "payload_bytes": record["payload_bytes"], "payload_digest": record["payload_digest"]}
                    row |= {"record_type": headers["warc-type"], "refers_to": page_of(headers.get("warc-refers-to"))}
                    rows.append(row | ({"payload": record["payload"]} if with_payload else {}))
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return bundles.select("data", "index").mapInArrow(run, schema)


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, page_id, bundle_id, frame, offset and length of every record: where to read it, without its bundle's data."""
    return bundles.select("bundle_id", F.explode("index").alias("at")).select("at.record_id", "at.page_id", "bundle_id", "at.frame", "at.offset", "at.length")


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records, payloads included, whose ids are in ``wanted.record_id``; ids that no bundle holds give no row.

    Of each bundle only the frames are decompressed in which a wanted record lies; what is gathered for a
    bundle is part of its own index, which ``bundle_bytes`` bounds.
    """
    spots = record_index(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    asked = spots.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length"))).alias("index"))
    return read_bundles(bundles.select("bundle_id", "data").join(asked, "bundle_id"), with_payload=True)


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisit rows of ``read_bundles`` for which no response has the page_id, digest and size that they refer to."""
    response = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return records.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages as bundles to the shared folder; the returned table has one row a bundle."""
    return stored(write_bundles(plan_records(pages)), "warc")


def warc_sql(revisit_bytes: int = 1000) -> str:
    return f"""
with b as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from b),
g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as winner from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {revisit_bytes} and page_id < winner then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {revisit_bytes} and page_id < winner then winner end as refers_to
from g
"""
