"""WARC archives: a distributed writer and a salvage reader.

Every record is a gzip member of its own. Spark's text writer joins lines of
members with an empty member as line separator, so files are plain
concatenations of members, on any file system that Spark writes to, under
Spark's commit protocol. Files end by bytes, not by records.

The reader checks each record: gzip checksum, version line, header fields,
length, end of record, block digest. Where a check fails it looks for the next
place that starts a valid member or version line, goes on from there, and logs
the bytes between as a gap. It does so inside a member as well: of a member
with several records the good ones stay. Of a member that is itself damaged or
cut off, what could be decompressed is searched too, and records whose block
digest holds are recovered; the member's bytes are logged as a gap all the same.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: An empty gzip member: what stands between two records in a file.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_REQUIRED = ("warc-type", "warc-record-id", "content-length")
_STEP = 1 << 16
_LINES = 128


@dataclass
class Record:
    """offset and length: of the record or the gzip member that holds it, in the archive; inner: where in the member's content the record starts."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes = field(repr=False)
    inner: int | None = None

    def payload(self) -> tuple[bytes, dict[str, str]]:
        """The HTTP body and its header fields, lines that aren't any left out; a block without HTTP header is payload as a whole."""
        if self.block.startswith(b"HTTP/"):
            head, sep, body = self.block.partition(b"\r\n\r\n")
            if sep:
                return body, _fields(head.split(b"\r\n")[1:], strict=False)
        return self.block, {}


@dataclass
class Gap:
    """Bytes of the archive without a valid record; with inner, `length` bytes from there on in the content of the member at offset."""

    offset: int
    length: int
    reason: str
    inner: int | None = None


class Damaged(ValueError):
    """A check failed; the text says which."""


def _fields(lines: list[bytes], strict: bool = True) -> dict[str, str]:
    """Header fields by lower-cased name; a line that starts with white space goes on the field before it."""
    found: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last is not None:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            if strict:
                raise Damaged("header field without colon")
            continue
        last = name.strip().decode("latin-1").lower()
        found[last] = value.strip().decode("utf-8", "replace")
    return found


def _number(text: str) -> int | None:
    """A length from a header; None if it is none or longer than any."""
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def _digest_holds(block: bytes, said: str) -> bool | None:
    """Whether the block has this digest; None if its kind isn't known."""
    kind, _, wanted = said.partition(":")
    if kind.lower() == "sha256":
        return hashlib.sha256(block).hexdigest() == wanted.lower()
    if kind.lower() == "sha1":
        digest = hashlib.sha1(block)
        return wanted.lower() == digest.hexdigest() or wanted == base64.b32encode(digest.digest()).decode()
    return None


def _id_text(page_id: object) -> str:
    return "" if page_id is None else quote(str(page_id), safe="")


def build_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """An uncompressed record. With refers_to, a revisit that carries HTTP header fields only."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{_id_text(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{_ID}{_id_text(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` decompresses to, where it ends, and why it isn't whole (empty if it is)."""
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if pos >= len(data):
                return b"".join(out), len(data), "gzip member is cut off"
            # A little at a time, so that what comes before a damaged place isn't lost with it.
            step = _STEP if pos + _STEP <= len(data) else 256
            out.append(unpacker.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error as e:
        return b"".join(out) + _before_damage(data, at, pos, len(b"".join(out))), min(pos, len(data)), f"gzip: {e}"
    return b"".join(out), min(pos, len(data)) - len(unpacker.unused_data), ""


def _before_damage(data: memoryview, at: int, pos: int, known: int) -> bytes:
    """What the member at `at` gives byte by byte beyond the `known` bytes that its input before pos gives."""
    unpacker = zlib.decompressobj(31)
    out = [unpacker.decompress(data[at:pos])]
    try:
        for i in range(pos, min(len(data), pos + _STEP)):
            out.append(unpacker.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)[known:]


def _record(data: bytes, at: int, verified: bool = False) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the plain record at `at`. verified: only one with a block digest is good."""
    line = _VERSION.match(data, at)
    if not line:
        raise Damaged("no version line")
    following = _VERSION.search(data, line.end())
    end = data.find(b"\r\n\r\n", line.end() - 2, following.start() + 2 if following else len(data))
    if end < 0:
        raise Damaged("a version line inside the header" if following else "header doesn't end")
    headers = _fields([x for x in data[line.end() : end].split(b"\r\n") if x])
    if missing := [k for k in _REQUIRED if k not in headers]:
        raise Damaged(f"no {missing[0]}")
    length = _number(headers["content-length"])
    if length is None:
        raise Damaged("bad content-length")
    start = end + 4
    stop = start + length
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record doesn't end where its length says")
    block = data[start:stop]
    holds = _digest_holds(block, headers.get("warc-block-digest", ""))
    if holds is False:
        raise Damaged("block digest differs")
    if verified and not holds:
        raise Damaged("no block digest to tell whether damage reached it")
    return headers, block, stop + 4


def _inside(content: bytes, at: int, length: int, verified: bool) -> Iterator[Record | Gap]:
    """Records and gaps of a member's content; at and length say where the member is."""
    pos, lost, reason = 0, -1, ""
    while pos < len(content):
        try:
            headers, block, end = _record(content, pos, verified)
        except Damaged as e:
            if lost < 0:
                lost, reason = pos, str(e)
            following = _VERSION.search(content, pos + 1)
            pos = following.start() if following else len(content)
            continue
        if lost >= 0:
            yield Gap(at, pos - lost, reason, lost)
            lost = -1
        yield Record(at, length, headers, block, pos)
        pos = end
    if lost >= 0:
        yield Gap(at, len(content) - lost, reason, lost)


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in order; apart from gaps inside members they cover every byte but empty members."""
    view, at = memoryview(data), 0
    lost, reason, saved = -1, "", []
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                content, end, damage = _member(view, at)
                found = list(_inside(content, at, end - at, bool(damage)))
                good = any(isinstance(x, Record) for x in found)
                if damage or (found and not good):
                    saved += found if good else []
                    raise Damaged(damage or found[0].reason)
            else:
                headers, block, end = _record(data, at)
                found = [Record(at, end - at, headers, block)]
        except Damaged as e:
            if lost < 0:
                lost, reason = at, str(e)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost >= 0:
            yield from saved
            yield Gap(lost, at - lost, reason)
            lost, saved = -1, []
        yield from found
        at = end
    if lost >= 0:
        yield from saved
        yield Gap(lost, len(data) - lost, reason)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, smallest: int = 100, file_bytes: int = 128 << 20) -> None:
    """Write a record per row: null payloads are empty, null urls leave the field out.

    Of rows whose payloads are equal and have at least `smallest` bytes, those
    with the smallest id are responses and all others revisit it; null ids come
    last. Payloads are shuffled only if the repeated ones are too many to send
    to every task; what is decided on is digests. A file ends when it has about
    file_bytes, so that a reader can take it as one value; a longer record is in a file
    with few others.
    """
    body = text_or_empty(payload_col)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"))
    digest = F.when(F.octet_length("body") >= smallest, F.sha2("body", 256))
    first = rows.select("id", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    first = cut(first.where("n > 1 and first_id is not null").select("digest", "first_id"), "repeated")
    typed = rows.withColumn("digest", digest).join(first, "digest", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    # A line of the text writer has members of this many bytes, and a file so many lines. A longer line is followed by empty ones, each an empty member, as if it were so many.
    line_bytes, lines_per_file = max(1, file_bytes // _LINES), _LINES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def line() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held), *[b""] * (-(-size // line_bytes) - 1)], pa.binary())], ["member"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for i, u, p, r in zip(part["id"], part["url"], part["body"], part["refers_to"], strict=True):
                    held.append(gzip_member(build_record(i, u, p.encode(), r)))
                    size += len(held[-1])
                    if size >= line_bytes:
                        yield line()
                        held, size = [], 0
        if held:
            yield line()

    members = typed.select(F.col("id").cast("string").alias("id"), "url", "body", refers.cast("string").alias("refers_to")).mapInArrow(build, "member binary")
    lines = members.select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", lines_per_file).text(path)


RECORD_SCHEMA = "archive string, offset long, length long, inner_offset long, gap string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record and gap of the archives at path. A gap has its reason in `gap` and nulls after it; payload_length of a revisit is what its HTTP header says."""

    def fields(name: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (name, x.offset, x.length, x.inner, x.reason, *[None] * 7)
        payload, http = x.payload()
        h, revisit = x.headers, x.headers["warc-type"] == "revisit"
        length = _number(http.get("content-length", "")) if revisit else len(payload)
        return (name, x.offset, x.length, x.inner, None, h["warc-type"], h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-payload-digest"), length, None if revisit else payload)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                size = 0
                for x in read_archive(content.as_py()):
                    held.append(fields(name, x))
                    size += x.length + (len(x.block) if isinstance(x, Record) else 0)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD_SCHEMA)


def log_gaps(found: DataFrame, path: str) -> None:
    """Write the quarantined byte ranges of read_warc's rows as JSON lines: archive, offset, length, inner_offset and the reason."""
    found.where("gap is not null").select("archive", "offset", "length", "inner_offset", "gap").write.json(path)


def page_of(column: str, kind: str = "BIGINT") -> Column:
    """The page id in a record id; null if it has none, or none of this kind."""
    return F.expr(f"try_cast(try_url_decode(replace(nullif(substring({column}, {len(_ID) + 1}), ''), '+', '%2B')) AS {kind})")
