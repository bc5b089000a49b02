"""WARC archives of web pages: writing with revisits and segments, reading back.

A page is a response record with its HTML in chunked transfer framing, or a revisit of the
record that holds the same payload. Blocks longer than a segment go on in continuation
records. Reading groups these by their origin's identifier, orders them by segment number,
verifies the total length and decodes the framing. Archives are gzip files written and
read by Spark, so they can be anywhere that Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscan.storage import save

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class BrokenArchive(ValueError):
    """A record that is not whole."""


# Writing


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(block: bytes, **fields: str) -> bytes:
    head = "".join(f"WARC-{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (head.encode(), len(block), block)


def page_records(row: dict, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, each with its closing blank lines."""
    payload, name = row["html"], row["name"]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    about = {"Date": DATE, "Target_URI": row["url"], "Payload_Digest": digest}
    if row["refers_to"] is not None:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        kind = {"Type": "revisit", "Refers_To": row["refers_to"], "Profile": PROFILE}
        yield _record(block, Record_ID=name, **kind, **about)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(block, Record_ID=name, Type="response", **about)
        return
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield _record(pieces[0], Record_ID=name, Type="response", Segment_Number="1", **about)
    for n, piece in enumerate(pieces[1:], 2):
        yield _record(
            piece,
            Record_ID=f"{name[:-1]}:{n}>",
            Type="continuation",
            Date=DATE,
            Segment_Origin_ID=name,
            Segment_Number=str(n),
            Segment_Total_Length=str(len(block)) if n == len(pieces) else None,
        )


def _archives(
    batches: Iterator[pa.RecordBatch], segment_bytes: int, archive_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Archives of about ``archive_bytes``, each one cell, without their last line break."""

    def archive(parts):
        return pa.record_batch([pa.array([b"".join(parts)[:-2]], pa.binary())], ["archive"])

    parts, size = [], 0
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(c) for c in names), strict=True):
            for record in page_records(dict(zip(names, (v.as_py() for v in values), strict=True)), segment_bytes):
                parts.append(record)
                size += len(record)
            if size >= archive_bytes:
                yield archive(parts)
                parts, size = [], 0
    if parts:
        yield archive(parts)


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record for each row of ``pages(page_id, url, html)``.

    Of rows with equal payloads of at least ``least_bytes`` the one with the largest
    ``page_id`` is a response, the others revisit it; smaller payloads are all responses.
    A null HTML counts as empty, a null URL as an empty one. Repeated rows get a record
    each, rows equal to the response in id and URL are responses too. Rows that share only
    these two are records of different names. A null ``page_id``
    comes before all others. Other columns are ignored.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    rows = pages.select("page_id", url.alias("url"), html.alias("html"))
    id_text = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = rows.withColumns(
        {
            "digest": F.unhex(F.sha1("html")),
            "name": F.concat(F.lit("<urn:page:"), id_text, F.lit(":"), F.hex(F.xxhash64("url")), F.lit(":"), F.sha1("html"), F.lit(">")),
        }
    )
    first = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
    first = first.agg(
        F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("page_id"), "name"))["name"].alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    # Only payloads that occur twice have anything to tell.
    first = first.filter("n > 1").select("digest", "first")
    named = rows.join(first, "digest", "left").select(
        "name", "url", "html", F.when(F.col("first") != F.col("name"), F.col("first")).alias("refers_to")
    )
    made = named.mapInArrow(lambda batches: _archives(batches, segment_bytes, archive_bytes), "archive binary")
    # A text file of one line: the bytes as they are, and the last line break.
    lines = made.select(F.col("archive").cast("string"))
    lines.write.options(lineSep="\r\n", compression="gzip", maxRecordsPerFile=1).text(path)


# Reading


def records(archive: bytes) -> Iterator[tuple[dict, bytes]]:
    """``(fields, block)`` of each record; field names in lower case."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise BrokenArchive(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        size = int(fields["content-length"])
        block = archive[start : start + size]
        if len(block) < size:
            raise BrokenArchive(f"record at byte {at} is cut short")
        yield fields, block
        at = start + size
        while archive.startswith(b"\r\n", at):
            at += 2


def payload_of(block: bytes) -> tuple[dict, bytes]:
    """``(HTTP fields, body)`` of a response, freed of chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if "chunked" not in fields.get("transfer-encoding", "").lower():
        return fields, body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise BrokenArchive("chunked body without an end")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return fields, b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(parts[-1]) < size or body[at : at + 2] != b"\r\n":
            raise BrokenArchive("chunk is cut short")
        at += 2


def joined_segments(pieces: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments ``(number, total length, block)`` in any order.

    Equal segments count once. Raises if one is missing or the total length differs.
    """
    by_number: dict[int, bytes] = {}
    total = None
    for number, length, block in pieces:
        if by_number.setdefault(number, block) != block:
            raise BrokenArchive(f"two segments {number}")
        total = length if length is not None else total
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise BrokenArchive(f"segments {sorted(by_number)}")
    whole = b"".join(by_number[n] for n in sorted(by_number))
    if total != len(whole):
        raise BrokenArchive(f"{len(whole)} bytes in segments instead of {total}")
    return whole


PAGE = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)
PARSED = (
    f"{PAGE}, origin string, segment int, total long, block binary"
)
_PARSED_TYPES = {
    "page_id": pa.int64(),
    "url": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "payload": pa.binary(),
    "origin": pa.string(),
    "segment": pa.int32(),
    "total": pa.int64(),
    "block": pa.binary(),
}
# Rows handed on at once while reading.
ROWS = 2_000


def _page_id(name: str | None) -> int | None:
    """From ``<urn:page:12:hash:digest>``."""
    number = name.split(":")[2] if name else ""
    return int(number) if number else None


def _page(fields: dict, block: bytes, with_payload: bool) -> dict:
    http, body = payload_of(block)
    kind = fields["warc-type"]
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = kind == "revisit"
    digest = stated if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
    if digest != stated:
        raise BrokenArchive(f"{fields['warc-record-id']}: digest {digest} instead of {stated}")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_bytes": int(http["content-length"]) if revisit else len(body),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_id(fields.get("warc-refers-to")),
        "payload": body if with_payload and not revisit else None,
    }


def _batch(rows: list[dict], names) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r.get(c) for r in rows], _PARSED_TYPES[c]) for c in names], list(names)
    )


def _parse(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Whole records decoded, segments as they are."""
    for batch in batches:
        for cell in batch.column("content"):
            content = cell.as_py()
            content = gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content
            rows = []
            for fields, block in records(content):
                if "warc-segment-number" not in fields:
                    rows.append(_page(fields, block, with_payload))
                else:
                    total = fields.get("warc-segment-total-length")
                    first = "warc-segment-origin-id" not in fields
                    rows.append(
                        {
                            "origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                            "segment": int(fields["warc-segment-number"]),
                            "total": int(total) if total else None,
                            "block": block,
                            "url": fields["warc-target-uri"] if first else None,
                            "payload_digest": fields["warc-payload-digest"] if first else None,
                        }
                    )
                if len(rows) >= ROWS:
                    yield _batch(rows, _PARSED_TYPES)
                    rows = []
            yield _batch(rows, _PARSED_TYPES)


def _reassemble(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = list(_PARSED_TYPES)[:7]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            pieces = row["pieces"]
            block = joined_segments([(p["segment"], p["total"], p["block"]) for p in pieces])
            firsts = [p for p in pieces if p["segment"] == 1]
            found = []
            # A page written twice has two first segments.
            for first in firsts:
                fields = {
                    "warc-type": "response",
                    "warc-record-id": row["origin"],
                    "warc-target-uri": first["url"],
                    "warc-payload-digest": first["payload_digest"],
                }
                found.append(_page(fields, block, with_payload))
            yield _batch(found, names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per page of the archives in a folder.

    ``payload_bytes`` and ``payload_digest`` (bare base32 SHA-1) are those of the full
    payload, for revisits too; ``payload`` is null for these, and without
    ``with_payload``. Raises on a record, segment or chunk that is not whole and on a
    wrong digest.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = save(files.mapInArrow(lambda b: _parse(b, with_payload), PARSED), "records").frame
    whole = parsed.filter("origin IS NULL").select(*list(_PARSED_TYPES)[:7])
    pieces = parsed.filter("origin IS NOT NULL").groupBy("origin")
    pieces = pieces.agg(F.collect_list(F.struct("segment", "total", "block", "url", "payload_digest")).alias("pieces"))
    return whole.union(pieces.mapInArrow(lambda b: _reassemble(b, with_payload), PAGE))
