"""WARC archives: one gzip member per record, and a reader that salvages what damage leaves.

Writing goes through Spark's text sink, whose task commit keeps files whole when an executor is lost; the separator that it puts after
each row is itself an empty gzip member, so files are plain ``.warc.gz`` to any reader. Reading checks every record (gzip's own
check sum, header, length, closing blank lines, block digest). After a failed check it looks for the next place where a valid
member or, in uncompressed files, a version line begins, goes on there, and logs the bytes between as a quarantined gap. Records of one
member are searched for by version lines in what it unpacks to, as far as it does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm.blobs import read_blobs, write_blobs
from xylem.llm.text import slices
from xylem.session import Workspace

#: Payloads from this size on are written once and revisited.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
#: A gzip member without content, as Latin-1 text.
_EMPTY = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Bytes of a record's block at most, as it becomes a value of a row (Spark's are below 2 GiB); a longer one is quarantined.
RECORD_BYTES = 1 << 30
_HOLD = 1 << 26  # bytes that a member is unpacked to as a whole; a longer one is unpacked twice, to check it and to read its records in turn
_STEP = 1 << 13  # bytes of a member unpacked at a time


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(page_id, url, digest: str, size: int, payload: bytes | None, refers_to=None) -> bytes:
    """A WARC record: ``payload`` None is a revisit of page ``refers_to``."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    revisit = payload is None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]-._')}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damage(Exception):
    """A failed check."""


class Short(Damage):
    """The data ends before the record does; ``need`` bytes would have it."""

    def __init__(self, reason: str, need: int):
        super().__init__(reason)
        self.need = need


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """The record that begins at ``at``: headers (lower case), block, and where it ends."""
    if not (m := VERSION.match(data, at)):
        here = bytes(data[at : at + 10])
        if b"WARC/1.0\r\n".startswith(here) or b"WARC/1.1\r\n".startswith(here):
            raise Short("no version line", at + 10)
        raise Damage("no version line")
    if (end := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
        raise Short("no end of header", len(data) + 1)
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("a header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise Damage("no content length")
    start, size = end + 4, int(headers["content-length"])
    if size > RECORD_BYTES:
        raise Damage(f"the block is longer than {RECORD_BYTES} bytes")
    if len(data) < start + size + 4:
        raise Short("the block does not end where its length says", start + size + 4)
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damage("the block does not end where its length says")
    block = bytes(data[start : start + size])
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damage("the block's digest differs")
    return headers, block, start + size + 4


def unpack(data: bytes, at: int) -> tuple[bytes | None, int, int, str, bool]:
    """What the gzip member at ``at`` unpacks to (None if more than _HOLD bytes), how many bytes that is, where it ends or fails, the reason of a failure and whether a check failed, so that what was unpacked can be wrong."""
    unzip, parts, size, begin = zlib.decompressobj(31), [], 0, at

    def keep(piece):
        nonlocal size
        size += len(piece)
        if size <= _HOLD:
            parts.append(piece)
        else:
            parts.clear()

    reason, failed = "", False
    try:
        # by small steps: what follows a member is never copied as a whole
        while not unzip.eof and at < len(data):
            step = data[at : at + _STEP]
            keep(unzip.decompress(step))
            at += len(step)
        end = at - len(unzip.unused_data)
        reason = "" if unzip.eof else "gzip: the member is cut short"
    except zlib.error as e:
        reason, failed = f"gzip: {e}", True
        # the failed step's content is lost: it is unpacked again, byte by byte
        unzip = zlib.decompressobj(31)
        try:
            for k in range(begin, at, _STEP):
                unzip.decompress(data[k : k + _STEP])
            for at in range(at, min(at + _STEP, len(data))):  # noqa: B020
                keep(unzip.decompress(data[at : at + 1]))
        except zlib.error:
            pass
        end = at
    return b"".join(parts) if size <= _HOLD else None, size, end, reason, failed


def _pieces(data: bytes, at: int, size: int) -> Iterator[tuple[bytes, int]]:
    """The first ``size`` bytes that the member at ``at`` unpacks to, in pieces, and up to where each has read."""
    unzip, width = zlib.decompressobj(31), _STEP
    while size > 0:
        step, before = data[at : at + width], unzip.copy()
        try:
            piece = unzip.decompress(step, size)
        except zlib.error:
            if width == 1:
                return
            unzip, width = before, 1  # the wanted bytes come before what fails: byte by byte from here
            continue
        if not step and not piece:
            return
        at += len(step) - len(unzip.unconsumed_tail)
        size -= len(piece)
        yield piece, at


def _consumed(data: bytes, at: int, size: int) -> int:
    """Up to where the member at ``at`` is read when its first ``size`` bytes are unpacked; more follow these."""
    for _, at in _pieces(data, at, size):  # noqa: B020
        pass
    return at


def _proven(headers: dict, block: bytes) -> bool:
    """Whether a digest shows that the block is whole; parse() has compared those of SHA-256."""
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    sha1 = hashlib.sha1(block)
    return kind == "sha256" or kind == "sha1" and digest.lower() in (sha1.hexdigest(), base64.b32encode(sha1.digest()).decode().lower())


def _inside(pieces: Iterator[bytes], doubtful: bool) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """As salvage(), over the content of one member, of which only the record that is being read is held; of ``doubtful`` content only records that a digest proves are good."""
    held, base, at, gap, reason, more = bytearray(), 0, 0, None, "", True
    need = 1
    while True:
        while more and len(held) < need:
            piece = next(pieces, None)
            more = piece is not None
            held += piece or b""
        if at >= len(held) and not more:
            break
        try:
            headers, block, end = parse(held, at)
            if doubtful and not _proven(headers, block):
                raise Damage("no digest proves this record of a damaged member")
        except Damage as e:
            if isinstance(e, Short) and more:
                need = max(e.need, len(held) + 1)
                continue
            if gap is None:
                gap, reason = base + at, str(e)
            line = VERSION.search(held, at + 1)
            # the start of a version line can stand at the end of what has come
            at = line.start() if line else max(at + 1, len(held) - 9) if more else len(held)
        else:
            if gap is not None:
                yield gap, base + at, None, b"", reason
                gap = None
            yield base + at, base + end, headers, block, ""
            at = end
        if at > _HOLD // 8 or at >= len(held):
            base += min(at, len(held))
            del held[:at]
            at = 0
        need = at + 1
    if gap is not None:
        yield gap, base + at, None, b"", reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(start, end, headers, block, "") of each good record, and (start, end, None, b"", reason) of each quarantined gap.

    Bytes are those of the file: records and gaps inside one member have the member's start and end (where it fails, the end of what its
    records needed), and such gaps tell their place in the content.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        end, why, found = None, "", iter(())
        if data.startswith(GZIP, at):
            content, size, end, why, doubtful = unpack(data, at)
            found = _inside(iter((content,)) if content is not None else (x for x, _ in _pieces(data, at, size)), doubtful)
            # what comes before the first good record
            before, first = [], None
            for first in found:
                if first[2] is not None:
                    break
                before.append(first)
            if before and first is before[-1]:
                first = None
            if first is None and (why or before):
                end, why = None, why or before[0][4]
            elif first is not None:
                found = chain(before, (first,), found)
        else:
            try:
                headers, block, end = parse(data, at)
                found = iter(((at, end, headers, block, ""),))
            except Damage as e:
                why = str(e)
        if end is not None:
            if gap is not None:
                yield gap, at, None, b"", reason
                gap = None
            good = 0
            # of a member that fails, records and gaps reach to where its good records needed it
            held = list(found) if why and content is not None else None
            if why:
                good = max(b for _, b, headers, _, _ in (held if held is not None else _inside((x for x, _ in _pieces(data, at, size)), doubtful)) if headers is not None)
                end = end if good == size else _consumed(data, at, good)
            for a, b, headers, block, error in held if held is not None else found:
                yield at, end, headers, block, error and f"{error} (bytes {a} to {b} of the member's content)"
            if not why:
                at = end
                continue
        if gap is None:
            gap, reason = at if end is None else end, why
        start = max(at + 1, end or 0)
        line = VERSION.search(data, start)
        nexts = [data.find(GZIP, start), line.start() if line else -1]
        at = min((x for x in nexts if x > 0), default=len(data))
    if gap is not None and gap < len(data):
        yield gap, len(data), None, b"", reason


def _records(batches):
    """Records as gzip members: of (page_id, url, html, digest, size, first)."""
    for batch in batches:
        for s in slices(batch, "html", 8 << 20):
            out = []
            for r in s.to_pylist():
                first = r["first"]
                revisit = first is not None and r["page_id"] != first
                out.append(member(record(r["page_id"], r["url"], r["digest"], r["size"], None if revisit else (r["html"] or "").encode(), first)))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["blob"])


def write_pages(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """One record per row of ``pages`` (page_id, url, html); null html is empty, a null url is left out.

    Of equal payloads of ``revisit_bytes`` at least, the smallest page_id's is written; others revisit it. Rows that repeat a page_id are the
    same capture and are written alike. A null page_id never comes first if another id has the payload. Other columns are not written. An
    empty table makes an archive without records.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # only payloads that occur again meet the rows: a short list in most archives, which adaptive execution then broadcasts
    again = rows.where(F.col("size") >= revisit_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    joined = rows.join(again, F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", "digest", "size", F.when(F.col("size") >= revisit_bytes, F.col("first")).alias("first"))
    write_blobs(joined.mapInArrow(_records, "blob binary"), path, after=_EMPTY)


def _read(batches):
    names = ["path", "start", "end", "type", "record_id", "refers_to", "uri", "payload_bytes", "payload_digest", "payload", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, size = [], 0
            for start, end, headers, block, error in salvage(content.as_py() or b""):
                if headers is None:
                    rows.append((path, start, end, None, None, None, None, None, None, None, error))
                else:
                    h, kind = headers.get, headers.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if h("content-type", "").startswith("application/http") else block
                    if kind == "revisit":
                        n, digest, payload = h("warc-payload-length"), h("warc-payload-digest", "").partition(":")[2], None
                        n = int(n) if n and n.isdigit() else None
                    else:
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((path, start, end, kind, h("warc-record-id"), h("warc-refers-to"), h("warc-target-uri"), n, digest, payload, None))
                    size += len(block)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record that can be saved, and every quarantined gap (``error`` not null: bytes start to end of a file were skipped).

    Columns: path, start, end, type, record_id, refers_to, uri, payload_bytes, payload_digest, payload, error. Digest and length are
    of the payload as read; a revisit's are as recorded. A file is one row of Spark's binary source, so archives are to be below 2 GiB each;
    write_pages() makes one of each partition. No files give no rows.
    """
    schema = "path string, start long, end long, type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary, error string"
    return read_blobs(spark, path).mapInArrow(_read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns: ``pages`` written as archives, then read from them."""
    work = Workspace(pages.sparkSession, "warc")
    path = work.path("archive")
    write_pages(pages, path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return read_warc(pages.sparkSession, path).where("error IS NULL").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
