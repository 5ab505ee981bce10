"""Legacy archives: ARC records are parsed by the header line of their version and become WARC records."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.llm.columns import as_id, in_small_batches
from tallyloom.llm.shingles import in_groups
from tallyloom.shared import cut, table_path

#: The fields of a header line, by version of the archive.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
NAMED = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: What an address and a date look like, by which a header line is told whose URL has no scheme.
IP, DATE = re.compile(r"-|[0-9.]+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*"), re.compile(r"[0-9]{14}")
#: Pairs of revisit and first record that are sent to the workers whole (32 bytes each and what a dict adds).
MOST_PAIRS = 500_000
#: Bytes of rows that a worker gathers before it passes them on.
HELD = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """One record of an ARC file: its header's fields and its block; truncated if the file ends before the declared length."""

    version: int
    offset: int
    fields: dict[str, str]
    block: bytes
    truncated: bool = False


def header_line(version: int, url: str, ip: str, date: str, mime: str, length: int, **more: str) -> bytes:
    """A header line; white space in a URL is percent-encoded, empty fields are a dash."""
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    values = {"url": url, "ip": ip, "date": date, "mime": mime or "no-type", "length": str(length), **more}
    return (" ".join(values.get(f) or "-" for f in FIELDS[version]) + "\n").encode()


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC file, which tells its version."""
    body = f"{version} 0 tallyloom\n{NAMED[version]}\n".encode()
    return header_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), status="200") + body


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file in order, one at a time in memory.

    The version comes from the first block; until then a line is read by its number of fields. A URL with spaces is
    kept whole, since the other fields are counted from the right. A URL without a scheme is taken if address and date
    are well-formed. Blank lines between records are skipped, as are lines that aren't a header (what a wrong length
    leaves over).
    """
    version, offset = None, 0
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not text.strip():
            continue
        kind = version or (2 if len(text.split(" ")) >= len(FIELDS[2]) else 1)
        parts = text.rsplit(" ", len(FIELDS[kind]) - 1)
        if len(parts) != len(FIELDS[kind]) or not parts[-1].isdigit():
            continue
        if ":" not in parts[0] and not (IP.fullmatch(parts[1]) and DATE.fullmatch(parts[2])):
            continue
        fields = dict(zip(FIELDS[kind], parts, strict=True))
        length = int(fields["length"])
        block = stream.read(length)
        offset += len(block)
        if version is None and fields["url"].startswith("filedesc:"):
            found = re.match(rb"(\d+) ", block)
            version = int(found[1]) if found and int(found[1]) in FIELDS else kind
        yield ArcRecord(kind, at, fields, block, len(block) < length)


def plain(value: str) -> str:
    """A header's value with bytes that aren't UTF-8 percent-encoded."""
    return re.sub("[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", value)


def iso_date(date: str) -> str:
    """The 14 digits of an ARC date (fewer are filled up) as a WARC date."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


_BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload)."""
    m = _BLANK_LINE.search(block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


@dataclass
class WarcRecord:
    """A WARC record: named fields in order, and block."""

    fields: dict[str, str]
    block: bytes

    def head(self) -> bytes:
        lines = [f"{k}: {v}" for k, v in self.fields.items()]
        return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(self.block)}"]) + "\r\n\r\n").encode()

    def to_bytes(self) -> bytes:
        return self.head() + self.block + b"\r\n\r\n"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def identifier(record: ArcRecord, archive: str) -> uuid.UUID:
    """A name-based UUID of archive, offset, URL and date, so converting again gives the same."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{record.offset}#{plain(record.fields['url'])}#{plain(record.fields['date'])}")


def is_version_block(record: ArcRecord) -> bool:
    return record.fields["url"].startswith("filedesc:") and not record.block.startswith(b"HTTP/")


def payload_of(record: ArcRecord) -> bytes:
    """What an HTTP block carries; any other block is its own payload."""
    return split_http(record.block)[1] if record.block.startswith(b"HTTP/") else record.block


def to_warc(record: ArcRecord, archive: str) -> WarcRecord:
    """The equivalent WARC record.

    A version block becomes warcinfo; a block of HTTP becomes response whatever its URL, anything else resource. Digests
    are computed from what is there, never taken over. Blocks are bytes and stay as they are, in any encoding.
    """
    f, block = {k: plain(v) for k, v in record.fields.items()}, record.block
    out = {"WARC-Record-ID": f"<urn:uuid:{identifier(record, archive)}>", "WARC-Date": iso_date(f["date"])}
    if is_version_block(record):
        block = f"software: tallyloom\r\nformat: WARC File Format 1.1\r\nconversion-of: {f['url']}\r\n".encode()
        return WarcRecord({"WARC-Type": "warcinfo", **out, "WARC-Filename": f["url"].removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}, block)
    out["WARC-Target-URI"] = f["url"]
    if f["ip"] not in ("-", "0.0.0.0"):
        out["WARC-IP-Address"] = f["ip"]
    kind, mime = ("response", "application/http; msgtype=response") if block.startswith(b"HTTP/") else ("resource", f["mime"])
    out |= {"WARC-Block-Digest": f"sha256:{sha256(block)}", "WARC-Payload-Digest": f"sha256:{sha256(payload_of(record))}"}
    if f["mime"] not in ("-", "no-type"):
        out["WARC-Identified-Payload-Type"] = f["mime"]
    if record.truncated:
        out["WARC-Truncated"] = "length"
    return WarcRecord({"WARC-Type": kind, **out, "Content-Type": mime}, block)


def as_revisit(record: WarcRecord, first_id: str) -> WarcRecord:
    """The record without its payload, pointing to the one that has it."""
    head = split_http(record.block)[0]
    fields = {**record.fields, "WARC-Type": "revisit", "WARC-Refers-To": first_id, "WARC-Profile": PROFILE, "WARC-Block-Digest": f"sha256:{sha256(head)}"}
    return WarcRecord(fields, head)


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """Records of a WARC file in order, by declared lengths, one at a time in memory."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name] = value.strip()
        yield WarcRecord(fields, stream.read(int(fields.pop("Content-Length", "0"))))


def opened(content: bytes | pa.Buffer) -> BinaryIO:
    """A stream over an archive file's bytes, decompressed as it is read."""
    found = pa.BufferReader(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=found) if bytes(content[:2]) == b"\x1f\x8b" else found, 1 << 16)


#: Fixed value: a gzip member's header (deflate, a name follows, no time, fastest, system unknown) and the name, whose end is a zero byte.
_MEMBER = b"\x1f\x8b\x08\x08\0\0\0\0\x04\xff" + b"record"


def gzip_rows(records: Iterator[bytes]) -> Iterator[bytes]:
    """Rows that make a file of one gzip member per record if a zero byte follows each.

    A row has the rest of its record's member and the beginning of the next one's, up to the name that the zero byte
    ends. The file's last zero byte is padding, which readers of gzip skip.
    """
    held = _MEMBER + b"\0"
    for n, record in enumerate(records):
        if n:
            yield held + _MEMBER
            held = b""
        deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
        held += deflate.compress(record) + deflate.flush() + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    if held != _MEMBER + b"\0":
        yield held


def in_batches(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """One binary column, some megabytes at a time."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row)
        if size > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            out, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def save(rows: DataFrame, path: str) -> None:
    """Write the rows of gzip_rows (column value) as files; Spark's text writer takes bytes as they are."""
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> int:
    """Write pages as ARC files below path, one file a partition, one gzip member a record; versions 1 and 2 take turns.

    Returns the number of pages. The column html may be text (written as UTF-8) or binary.
    """
    base = in_small_batches(pages).select(as_id(pages, id_col, "page_id"), pages[url_col].cast("string"), F.coalesce(pages[html_col].cast("binary"), F.lit(b"")))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part = TaskContext.get().partitionId()
        version, name, first = 1 + part % 2, f"part-{part:05d}.arc", True
        for b in in_groups(batches, 2):
            if first and b.num_rows:
                yield version_block(version, name, date) + b"\n"
                first = False
            for page, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mark = f"X-Page-Id: {page}\r\n" if page is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body
                more = {"status": "200", "filename": name, "checksum": sha256(body)} if version == 2 else {}
                yield header_line(version, url or "http://unknown.invalid/", "192.0.2.1", date, "text/html", len(block), **more) + block + b"\n"

    written = Observation()
    save(base.observe(written, F.count(F.lit(1)).alias("n")).mapInArrow(lambda batches: in_batches(gzip_rows(records(batches))), "value binary"), path)
    return written.get.get("n", 0)


def header_of(block: bytes, name: bytes) -> bytes | None:
    """One field of an HTTP header."""
    m = re.search(rb"^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", split_http(block)[0], re.M | re.I)
    return m[1] if m else None


def convert(spark, arc_path: str, warc_path: str, least_bytes: int = 100, pages: int = 0) -> None:
    """Convert the ARC files below arc_path to WARC files below warc_path, one gzip member a record; fails if it finds fewer captures than pages.

    Of responses with equal payloads of least_bytes or more the one with the smallest page id keeps its payload, the
    others become revisits; resources stay whole. A first pass lists records without payloads; firsts are found by
    partial aggregation and give the few pairs (revisit, first). The second pass converts each file in place: up to
    MOST_PAIRS pairs are sent to the workers (32 bytes each), more are joined by record, whose ids are even.
    An archive file has to be below 2 GB (Spark's reader refuses larger ones).
    """
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, ArcRecord]]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                archive = path.rsplit("/", 1)[-1]
                yield from ((archive, r) for r in read_arc(opened(content.as_buffer())) if not is_version_block(r))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)], names=["page_id", "record", "digest", "size"])
        for archive, r in parsed(batches):
            payload = payload_of(r)
            page = header_of(r.block, b"X-Page-Id")
            rows.append((int(page) if page else None, identifier(r, archive).bytes, hashlib.sha256(payload).digest(), len(payload) if r.block.startswith(b"HTTP/") else 0))
            if len(rows) >= 10_000:
                yield batch()
                rows.clear()
        yield batch()

    index = cut(files.mapInArrow(listed, "page_id long, record binary, digest binary, size long"), "arc-index")
    if (n := index.count()) < pages:
        raise ValueError(f"{arc_path}: {n} captures were read of {pages} that were written")
    large = index.filter(F.col("size") >= least_bytes)
    firsts = (
        large.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "record")).alias("first"))
        .filter("n > 1")
        .select("digest", F.col("first.page_id").alias("first_page"), F.col("first.record").alias("first"))
    )
    again = large.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first_page")))
    pairs = cut(again.select("record", "first"), "revisits")

    def warcs(found: Iterator[tuple[str, ArcRecord, bytes | None]]) -> Iterator[bytes]:
        name, first = f"part-{TaskContext.get().partitionId():05d}.warc", True
        for archive, r, revisits in found:
            if first:
                yield to_warc(ArcRecord(1, 0, {"url": f"filedesc://{name}", "ip": "-", "date": "20240101000000", "mime": "text/plain", "length": "0"}, b""), name).to_bytes()
                first = False
            w = to_warc(r, archive)
            yield (as_revisit(w, f"<urn:uuid:{uuid.UUID(bytes=revisits)}>") if revisits else w).to_bytes()

    if pairs.count() <= MOST_PAIRS:
        sent = spark.sparkContext.broadcast(dict(pairs.toArrow().to_pandas().itertuples(index=False, name=None)))

        def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            yield from in_batches(gzip_rows(warcs((archive, r, known.get(identifier(r, archive).bytes)) for archive, r in parsed(batches))))

        save(files.mapInArrow(converted, "value binary"), warc_path)
        return

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for archive, r in parsed(batches):
            rows.append((identifier(r, archive).bytes, archive, json.dumps([r.version, r.offset, r.fields, r.truncated]), r.block))
            held += len(r.block)
            if held > HELD:
                yield packed(rows)
                rows, held = [], 0
        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.binary(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)], names=["record", "archive", "head", "block"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, ArcRecord, bytes | None]]:
        for b in in_groups(batches, "block"):
            for archive, head, block, first in zip(*(b.column(c).to_pylist() for c in ("archive", "head", "block", "first")), strict=True):
                version, offset, fields, truncated = json.loads(head)
                yield archive, ArcRecord(version, offset, fields, block, truncated), first

    joined = files.mapInArrow(records, "record binary, archive string, head string, block binary").join(pairs, "record", "left")
    save(joined.select("archive", "head", "block", "first").mapInArrow(lambda batches: in_batches(gzip_rows(warcs(unpacked(batches)))), "value binary"), warc_path)


def read_back(spark, warc_path: str) -> DataFrame:
    """One row per capture in the WARC files: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id, captured_at).

    A response's payload is measured and hashed as it is read; a revisit tells its payload's size and digest in its
    headers. refers_to is the page id of the record that a revisit names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_id", "target_uri", "record_id", "captured_at"]
        for b in batches:
            for content in b.column(0):
                out = []
                for w in read_warc(opened(content.as_buffer())):
                    kind = w.fields["WARC-Type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    page = header_of(w.block, b"X-Page-Id")
                    if kind == "revisit":
                        size, digest = int(header_of(w.block, b"Content-Length") or 0), w.fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    else:
                        payload = split_http(w.block)[1] if kind == "response" else w.block
                        size, digest = len(payload), sha256(payload)
                        if w.fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"{w.fields['WARC-Record-ID']}: the payload isn't the one that was written")
                    out.append((int(page) if page else None, size, digest, kind, w.fields.get("WARC-Refers-To"), w.fields.get("WARC-Target-URI"), w.fields["WARC-Record-ID"], w.fields["WARC-Date"]))
                c = list(zip(*out, strict=True)) if out else [()] * 8
                types = [pa.int64(), pa.int64(), *[pa.string()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=names)

    found = spark.read.format("binaryFile").load(warc_path).select("content")
    found = cut(found.mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string, target_uri string, record_id string, captured_at string"), "captures")
    named = found.filter("refers_id is not null").select("refers_id").distinct().join(found.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")), "refers_id")
    named = named.groupBy("refers_id").agg(F.min("refers_to").alias("refers_to"))
    return found.join(named, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "captured_at")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Write pages as ARC, convert to WARC with revisits, and read the WARC files back: one row per row of pages.

    Archives lie in the shared folder. Each file is one partition's records; a worker has the compressed file in memory
    and one record at a time.

    Any url is kept, also without a scheme or of another than HTTP; the run fails if fewer captures are read than pages
    were written.

    Nulls: a null html is an empty payload; a null url becomes http://unknown.invalid/; a null id stays null and is
    never the first of equal payloads while there are others. Empty payloads and those below least_bytes are always
    responses. Very long payloads: one record at a time in memory. Ties: smallest page id. Repeated rows: rows of the
    id that keeps its payload are all responses. Empty table: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = table_path(spark, "arc"), table_path(spark, "warc")
    n = write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc, least_bytes, n)
    return read_back(spark, warc)
