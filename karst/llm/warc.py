"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Writer: one gzip member per record (WARC/1.1). Of records with equal payloads of at least min_bytes, that with the largest
page_id is a response (all of them, if several rows share that id), the others are revisits that refer to it and keep only
the HTTP head. Equal payloads are found by SHA-1 and length with map-side aggregation, so a payload that a third of all
pages share costs one row per task.

Reader: walks a file by gzip members or, in plain archives, version lines. Each record must inflate, parse, have the stated
length and end, and match its digests. When a check fails it searches for the next version line of the member, or the next
member or version line of the file, that passes all of them, goes on there, and reports the bytes between as a quarantined gap.
Members are inflated a piece at a time; one record is in memory.

Edge cases: null html is an empty payload; null page_id is written as "null", never wins over an id, and is read as null;
null url is an empty URI; control characters of a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.token_files import _publish, mapped
from karst.sources.shared import cut, new_path, spread

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
PIECE = 1 << 20

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"


def base32_sha1(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record, not compressed. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base32_sha1(payload)
    if not revisit:
        block += payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + END


def member(raw: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(ValueError):
    pass


class Short(Damaged):
    """The bytes at hand end before the record does."""


def parse(raw, at: int = 0) -> tuple[dict, int]:
    """The record at `at` and the position after it. Raises Damaged if any check fails."""
    if bytes(raw[at : at + 7]) != VERSION:
        raise Damaged("no version line")
    head_end, step = -1, 1 << 14
    while head_end < 0:
        head = bytes(raw[at : at + step])
        head_end = head.find(END)
        if head_end < 0 and step >= 1 << 22:
            raise Damaged("head has no end")
        if head_end < 0 and at + step >= len(raw):
            raise Short("head has no end")
        step <<= 2
    lines = head[:head_end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    start = at + head_end + 4
    stop = start + int(fields["content-length"])
    if stop + 4 > len(raw):
        raise Short("length and end differ")
    if bytes(raw[stop : stop + 4]) != END:
        raise Damaged("length and end differ")
    block = bytes(raw[start:stop])
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    kind = fields.get("warc-type", "")
    http, _, payload = block.partition(END) if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    size = len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http):
            size = int(m[1])
    else:
        own = base32_sha1(payload)
        if digest and digest != own:
            raise Damaged("payload digest differs")
        digest = own
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload, "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("warc-refers-to")}, stop + 4


class _Inflated:
    """The inflated bytes of the member at `at`, a piece at a time: buf holds those that no record has used yet."""

    def __init__(self, data, at: int):
        self.data, self.p, self.z, self.buf, self.error = data, at, zlib.decompressobj(31), bytearray(), None

    def more(self) -> bool:
        """Add at most PIECE bytes to buf; False at the end of the member or at its damage."""
        while not self.z.eof and self.error is None:
            some = self.z.unconsumed_tail or bytes(self.data[self.p : self.p + (1 << 16)])
            if not some:
                self.error = "member is cut off"
                break
            if not self.z.unconsumed_tail:
                self.p += len(some)
            try:
                out = self.z.decompress(some, PIECE)
            except zlib.error as e:
                self.error = f"member: {e}"
                break
            if self.z.eof:
                self.p -= len(self.z.unused_data)
            if out:
                self.buf += out
                return True
        return False


def _member_records(data, at: int) -> Iterator[tuple[str, int, dict | str]]:
    """('record', place reached, fields) of every intact record of a member, ('bad', place, reason) where it goes on at a later
    version line, and at last ('end' or 'damaged', place, reason). Bytes of one record are held, as far as its length is right."""
    m, bad = _Inflated(data, at), None
    while True:
        if len(m.buf) < 1 << 14 and m.more():
            continue
        if not m.buf:
            break
        try:
            r, stop = parse(m.buf)
        except Damaged as e:
            if isinstance(e, Short) and m.more():
                continue
            bad = bad or str(e)
            i = m.buf.find(VERSION, 1)
            del m.buf[: i if i > 0 else max(len(m.buf) - len(VERSION) + 1, 1)]
            continue
        if bad:
            yield "bad", m.p, bad
            bad = None
        del m.buf[:stop]
        yield "record", m.p, r
    if bad and m.error is None:
        yield "bad", m.p, bad
    yield "end" if m.error is None else "damaged", m.p, m.error or ""


def _find(data, sub: bytes, at: int, block: int = 1 << 20) -> int:
    while at < len(data):
        i = bytes(data[at : at + block + len(sub) - 1]).find(sub)
        if i >= 0:
            return at + i
        at += block
    return len(data)


def _records_at(data, at: int) -> Iterator[tuple[str, int, dict | str]]:
    """As _member_records, for a member or a plain record."""
    if bytes(data[at : at + 3]) == MAGIC:
        yield from _member_records(data, at)
        return
    try:
        r, end = parse(data, at)
    except Damaged as e:
        yield "damaged", at, str(e)
        return
    yield "record", end, r
    yield "end", end, ""


def salvage(data) -> Iterator[tuple[str, int, int, dict | str]]:
    """('record', start, end, fields) and ('gap', start, end, reason) of an archive: bytes or an array of them. A record of a
    member starts where the member does and ends where its last byte was read; gaps inside a member have the member's bounds. Every intact record is found, also those before and after damage in their own member."""
    at, n = 0, len(data)
    lost: tuple[int, str] | None = None  # where the present gap began, and why
    while at < n:
        some = False
        for kind, place, what in _records_at(data, at):
            if kind == "record":
                if lost:
                    yield "gap", lost[0], at, lost[1]
                    lost = None
                some = True
                yield "record", at, place, what
            elif kind == "bad" and some:
                yield "gap", at, place, f"inside a member: {what}"
            elif kind == "bad":
                lost = lost or (at, what)
            else:
                last = kind, place, what
        kind, place, what = last
        if kind == "end" and some:
            at = place
            continue
        lost = lost or (at, what or "no record")
        at = min(_find(data, MAGIC, at + 1), _find(data, VERSION, at + 1))
    if lost:
        yield "gap", lost[0], n, lost[1]


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, winner: the page that a record with an equal payload revisits, if it is not one's own."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns({"_sha": F.sha1("payload"), "_len": F.octet_length("payload")})
    groups = p.select("page_id", "_sha", "_len").where(F.col("_len") >= min_bytes).groupBy("_sha", "_len").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null").drop("n")
    return p.join(cut(groups, "warc-groups"), ["_sha", "_len"], "left")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives to the folder, now; returns file names and record counts."""
    from pyspark import TaskContext

    schema = pa.schema([("file", pa.string()), ("n", pa.int64())])

    def write(batches):
        rows = ((i, u, p, w) for b in batches for i, u, p, w in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "winner")), strict=True))
        part, k, more = TaskContext.get().partitionId(), 0, next(rows, None)
        while more is not None:
            name, n, size = f"pages-{part:05d}-{k:04d}.warc.gz", 0, 0
            with _publish(folder, name) as f:
                while more is not None and size < file_bytes:
                    i, u, p, w = more
                    size += f.write(member(record(i, u, p, w, w is not None and w != i)))
                    n += 1
                    more = next(rows, None)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], schema=schema)

    rows = with_roles(spread(pages), min_bytes).select("page_id", "url", "payload", "winner")
    return cut(rows.mapInArrow(write, "file string, n long"), "warc-files")


FIELDS = [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
SCHEMA = "file string, start long, end long, gap string, record_id string, record_type string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def read_warc(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record, and one per quarantined gap (gap: the reason), of the named files of the folder."""
    schema = pa.schema(FIELDS)

    def rows(name):
        with mapped(folder, name, "u1") as data:
            for kind, a, z, r in salvage(data):
                yield {"file": name, "start": a, "end": z} | ({"gap": r} if kind == "gap" else r if payloads else r | {"payload": None})

    def read(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                some, size = [], 0
                for r in rows(name):
                    some.append(r)
                    size += 200 + len(r.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    n = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("file").repartition(n, "file").mapInArrow(read, SCHEMA)


def page_of(urn: str) -> F.Column:
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and return one row per record. Quarantined gaps are logged."""
    folder = new_path(pages.sparkSession, "warc")
    files = write_warc(pages, folder, min_bytes)
    found = cut(read_warc(files, folder, payloads=False).drop("payload"), "warc-records")
    gaps = found.where("gap is not null")
    if n := gaps.count():
        logging.getLogger(__name__).warning("%d quarantined gaps in %s, the first: %s", n, folder, gaps.select("file", "start", "end", "gap").first())
    return found.where("gap is null").select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
