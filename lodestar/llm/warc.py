"""Legacy ARC archives, their conversion to WARC, and reading both back.

An ARC file starts with a version block that names the fields of the record header lines: five in version 1, ten in version 2. Each
record is such a line, as many bytes as it declares, and a line feed. The converter parses the lines by the declared fields (from the
right, as URLs may hold spaces), and synthesises what WARC asks for: record ids from archive and place in it, ISO dates from
the 14-digit ones, types, and SHA-1 digests of payload and block. Of equal payloads the first page's record is a response and the others
are revisits without a body, which refer to it.

Archives are rows (name, content), as Spark's binaryFile source also gives them, of about ARCHIVE_BYTES each, so that a task holds one
at a time. Which record comes first is found by an aggregation over (digest, page); payloads never meet by digest. Archives are shuffled once, whole and by
name, to meet the list of their revisits.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, release, stored

ARCHIVE_BYTES = 1 << 20
ARCHIVE_RECORDS = 500
# The header fields of ARC version 1 and 2, and the WARC revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_SCHEMA = "name string, content binary"
RECORD_SCHEMA = "name string, place int, page_id long, payload_digest string"
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC


def arc_header(version: int, url: str, date: str, mime: str, code: int, checksum: str, offset: int, name: str, length: int) -> str:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": code, "Checksum": checksum, "Location": "-", "Offset": offset, "Filename": name, "Archive-length": length}
    return " ".join(str(values[f]) for f in ARC_FIELDS[version].split()) + "\n"


class ArcWriter:
    def __init__(self, name: str, version: int):
        self.name, self.version, self.parts, self.size, self.records = name, version, [], 0, 0
        body = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n\n".encode()
        self._put(arc_header(version, f"filedesc://{name}", "20000101000000", "text/plain", 200, "-", 0, name, len(body)).encode() + body + b"\n")

    def _put(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def add(self, page, url: str | None, date: str, payload: bytes) -> None:
        """A record whose body is an HTTP response; the page's number travels as an HTTP header. White space in URLs is percent-encoded."""
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        url = "".join(urllib.parse.quote(c) if c.isspace() else c for c in url or "") or "unknown:"
        line = arc_header(self.version, url, date, "text/html", 200, hashlib.md5(payload).hexdigest(), self.size, self.name, len(head) + len(payload))
        self._put(line.encode() + head + payload + b"\n")
        self.records += 1

    def content(self) -> bytes:
        return b"".join(self.parts)


def arc_records(content: bytes):
    """(header fields, body) of each record after the version block; raises if the lengths don't fit."""
    at, names = 0, None
    while at < len(content):
        end = content.index(b"\n", at)
        line = content[at:end].decode()
        if names is None:  # the version block ends with its length in either version
            length = int(line.rsplit(" ", 1)[1])
            names = content[end + 1 : end + 1 + length].split(b"\n")[1].decode().split()
        else:
            fields = dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True))
            length = int(fields["Archive-length"])
            yield fields, content[end + 1 : end + 1 + length]
        at = end + 1 + length
        if content[at : at + 1] != b"\n":
            raise ValueError(f"a record of {length} bytes doesn't end at byte {at}")
        at += 1


def http_parts(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), their bytes, and the payload."""
    head, _, payload = body.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, head + b"\r\n\r\n", payload


def page_number(headers: dict[str, str]) -> int | None:
    return int(headers["x-page-id"]) if headers.get("x-page-id") else None


# WARC


def iso_date(date: str) -> str:
    d = (date + "00000000000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{archive}:{place}'.encode()).digest()[:16], version=4)}>"


def warc_record(fields: dict[str, str], body: bytes, identity: str, refers: tuple[int, str] | None = None) -> bytes:
    """One gzip member: the WARC record equivalent to an ARC record; a revisit if `refers` has the page and the record id of a response."""
    headers, head, payload = http_parts(body)
    block = body if refers is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {identity}", f"WARC-Date: {iso_date(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if refers is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers[1]}", f"X-Refers-To-Page-Id: {refers[0]}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def warc_records(content: bytes):
    """(headers with lower-case names, block) of each gzip member of an archive."""
    while content:
        unpacker = zlib.decompressobj(31)
        record = unpacker.decompress(content)
        content = unpacker.unused_data
        head, _, rest = record.partition(b"\r\n\r\n")
        pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
        block = rest[: int(headers["content-length"])]
        if headers["warc-block-digest"] != f"sha1:{sha1(block)}":
            raise ValueError(f"block digest of {headers['warc-record-id']} doesn't fit")
        yield headers, block


# Spark


def _batch(schema: str, rows: list):
    import pyarrow as pa

    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])


def write_arc(pages: DataFrame, page: str = "page_id", url: str = "url", date: str = "date", payload: str = "html") -> DataFrame:
    """Archives (name, content) with a record for each row; versions 1 and 2 alternate.

    `page` is a whole number; text that is none raises. A null payload is empty; a null URL becomes `unknown:`, a null date 1 January 2000. Other columns are not read. An empty table gives no archives.
    """

    def archives(batches):
        writer, run, count = None, uuid.uuid4().hex, 0
        for batch in batches:
            for number, link, when, text in zip(*columns(batch, "page", "url", "date", "payload"), strict=True):
                if writer is None:
                    writer = ArcWriter(f"{run}-{count:06d}.arc", 1 + count % 2)
                    count += 1
                writer.add(number, link, when or "20000101000000", (text or "").encode())
                if writer.size >= ARCHIVE_BYTES or writer.records >= ARCHIVE_RECORDS:
                    yield _batch(ARC_SCHEMA, [(writer.name, writer.content())])
                    writer = None
        if writer is not None:
            yield _batch(ARC_SCHEMA, [(writer.name, writer.content())])

    return pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.col(date).alias("date"), F.col(payload).alias("payload")).mapInArrow(archives, ARC_SCHEMA)


def list_arc(archives: DataFrame) -> DataFrame:
    """(name, place, page_id, payload_digest) of every ARC record."""

    def listed(batches):
        for batch in batches:
            for name, content in zip(*columns(batch, "name", "content"), strict=True):
                rows = []
                for place, (_, body) in enumerate(arc_records(content)):
                    headers, _, payload = http_parts(body)
                    rows.append((name, place, page_number(headers), sha1(payload)))
                yield _batch(RECORD_SCHEMA, rows)

    return archives.select("name", "content").mapInArrow(listed, RECORD_SCHEMA)


def convert(archives: DataFrame) -> DataFrame:
    """WARC archives (name, content) from ARC archives with unique names; both are stored on the way.

    Of records with equal payloads, one of the smallest page number is the response and all others revisit it, repeated rows of its page, too. Records
    without a number come last; where none of equal ones has a number, all are responses. An empty table gives no archives.
    """
    listed = stored(list_arc(archives), "warc-records")
    place = F.struct("page_id", "name", "place")
    first = listed.groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), place)).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    first = stored(first, "warc-first")  # stored, so that the join stands alone in its stage, where Spark can split a frequent digest
    later = listed.join(first, "payload_digest").where((F.col("name") != F.col("first.name")) | (F.col("place") != F.col("first.place")))
    later = later.groupBy("name").agg(F.collect_list(F.struct("place", "first")).alias("refers"))

    def converted(batches):
        for batch in batches:
            for name, content, refers in zip(*columns(batch, "name", "content", "refers"), strict=True):
                known = {r["place"]: (r["first"]["page_id"], record_id(r["first"]["name"], r["first"]["place"])) for r in refers or ()}
                members = [warc_record(fields, body, record_id(name, k), known.get(k)) for k, (fields, body) in enumerate(arc_records(content))]
                yield _batch(ARC_SCHEMA, [(name.removesuffix(".arc") + ".warc.gz", b"".join(members))])

    made = stored(archives.join(later, "name", "left").select("name", "content", "refers").mapInArrow(converted, ARC_SCHEMA), "warc-archives", large_rows=True)
    release(listed, first)
    return made


def read_warc(archives: DataFrame) -> DataFrame:
    """One row for each WARC record: page, size and digest of the full payload, type, and the page that a revisit refers to.

    The payload of a response is digested anew and checked; that of a revisit isn't there, so its headers tell.
    """

    def pages(batches):
        for batch in batches:
            for content in columns(batch, "content")[0]:
                rows = []
                for headers, block in warc_records(content):
                    http, _, payload = http_parts(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and sha1(payload) != digest:
                        raise ValueError(f"payload digest of {headers['warc-record-id']} doesn't fit")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    refers = headers.get("x-refers-to-page-id")
                    rows.append((page_number(http), size, digest, kind, int(refers) if refers else None))
                yield _batch(PAGE_SCHEMA, rows)

    return archives.select("content").mapInArrow(pages, PAGE_SCHEMA)
