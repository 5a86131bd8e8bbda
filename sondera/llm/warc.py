"""WARC archives: a writer, and a salvage reader for damaged ones.

The reader goes from record to record.  A gzip member must inflate to its end with the right check
sum, a record must have its version line, headers, a block of Content-Length bytes and the closing
blank lines, and a block digest, if there is one, must be right.  Where a check fails, the reader
searches on for the next place at which a member or a version line begins and all checks hold,
takes up there, and logs the bytes between as a quarantined gap.

The same holds inside a member: of one that is damaged, what inflated before the damage is kept, and
in it as in a whole one the reader goes on from a bad record to the next version line.  Where the
member itself is damaged, a record must have a digest that is right, unless the member is only
truncated.  As a digest says nothing of the headers, such a record bears the member's reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, rows_of

MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+)[ \t]*:((?:[ \t]|[^\x00-\x20\x7f])*)")
_FOLDED = re.compile(rb"[ \t]+(?:[ \t]|[^\x00-\x20\x7f])*")
#: By name without hyphens and underscores; those of free length have no fixed digest.
_ALGORITHMS = {name.replace("-", "").replace("_", ""): name for name in sorted(hashlib.algorithms_guaranteed) if not name.startswith("shake")}


class Damaged(Exception):
    """A check that failed; the text says which."""


@dataclass
class Record:
    offset: int
    length: int  # bytes of the archive; those of the member for a compressed record
    headers: dict[str, str]
    block: bytes
    compressed: bool = False
    reason: str = ""  # the check that its member failed


@dataclass
class Gap:
    offset: int
    length: int
    reason: str
    inside: tuple[int, int] | None = None  # of a gap in a member: where in the inflated bytes; offset and length are the member's


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = {**headers, "WARC-Block-Digest": f"sha1:{digest}", "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def digest_holds(headers: dict[str, str], block: bytes) -> bool | None:
    """Whether the block digest, in hexadecimal or base32, is right; None without one of an algorithm that hashlib knows."""
    kind, _, value = headers.get("warc-block-digest", "").partition(":")
    name, value = kind.strip().lower(), value.strip()
    name = _ALGORITHMS.get(name.replace("-", "").replace("_", ""))
    if not name:
        return None
    right = hashlib.new(name, block, usedforsecurity=False).digest()
    return value.lower() == right.hex() or value.upper().rstrip("=") == base64.b32encode(right).decode().rstrip("=")


def parse(data, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: headers, block, where it ends."""
    found = _VERSION.match(data, at)
    if not found:
        raise Damaged("version")
    end = data.find(b"\r\n\r\n", found.end() - 2)
    if end < 0:
        raise Damaged("headers")
    headers: dict[str, str] = {}
    name = ""
    for line in bytes(data[found.end() : max(end, found.end())]).split(b"\r\n"):
        field = _FIELD.fullmatch(line)
        if field and field[1].lower() not in (b"content-length", b"warc-record-id") or field and field[1].decode().lower() not in headers:
            name = field[1].decode().lower()
            headers[name] = field[2].decode("utf-8", "replace").strip()
        elif name and _FOLDED.fullmatch(line):
            headers[name] += " " + line.decode("utf-8", "replace").strip()
        else:  # another record's bytes, most likely
            raise Damaged("headers")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damaged("headers")
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or len(size) > 18:
        raise Damaged("length")
    start = end + 4
    stop = start + int(size)
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        raise Damaged("length")
    block = bytes(data[start:stop])
    if digest_holds(headers, block) is False:
        raise Damaged("digest")
    return headers, block, stop + 4


def inflate(data, at: int, stop: int | None = None) -> tuple[bytes, int, str]:
    """What inflates of the gzip member at ``at``, before ``stop``, where that ends, and the check that failed: check sum and size are verified."""
    z, out, place, step = zlib.decompressobj(31), [], at, 1 << 16
    stop = len(data) if stop is None else stop
    while not z.eof:
        piece = bytes(data[place : min(place + step, stop)])
        if not piece:
            return b"".join(out), place, "truncated"
        before = z.copy()
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            return b"".join([*out, *(some := _before_error(before, piece))[0]]), place + some[1], "gzip"
        place += len(piece)
        step = min(step * 2, 1 << 22)
    return b"".join(out), place - len(z.unused_data), ""


def _before_error(z, piece: bytes) -> tuple[list[bytes], int]:
    """What ``z`` makes of the bytes before the one at which it fails, and how many these are."""
    out, at, step = [], 0, len(piece)
    while step := min(step, len(piece) - at):
        before = z.copy()
        try:
            out.append(z.decompress(piece[at : at + step]))
            at += step
        except zlib.error:
            z, step = before, step // 2
    return out, at


def _inside(data: bytes, failed: str) -> Iterator[Record | Gap]:
    """Records and gaps of the inflated bytes of a member, which failed a check or not."""
    k = 0
    while k < len(data):
        begin, why, got = k, "", None
        while k < len(data) and not got:
            try:
                headers, block, end = parse(data, k)
                if failed not in ("", "truncated") and not digest_holds(headers, block):
                    raise Damaged(failed)
                got = Record(0, 0, headers, block, True, failed)
            except Damaged as e:
                why = why or str(e)
                found = _VERSION.search(data, k + 1)
                k = found.start() if found else len(data)
        if k > begin:
            yield Gap(0, 0, why, (begin, k - begin))
        if got:
            yield got
            k = end
            if k == len(data) and failed:  # the rest didn't inflate
                yield Gap(0, 0, failed, (k, 0))


def _take(data, at: int, stop: int | None = None) -> tuple[list[Record | Gap], int, bool]:
    """What can be had of the member, which ends before ``stop``, or the one record at ``at``, how far that was read, and whether it surely ends there."""
    if bytes(data[at : at + 3]) == MAGIC:
        inside, end, failed = inflate(data, at, stop)
        found = list(_inside(inside, failed))
        if not any(isinstance(x, Record) for x in found):
            raise Damaged(failed or (found[0].reason if found else "version"))
        return found, end, not failed
    headers, block, end = parse(data, at)
    return [Record(at, end - at, headers, block)], end, True


def _next(data, at: int, had: list[Record | Gap] | None = None, until: int = 0) -> tuple[int, list[Record | Gap], int, bool, str]:
    """The next place from ``at`` on where something can be had, with what ``_take`` says of it, and the check that failed at ``at``.

    Records of ``had`` that are met again before ``until`` don't count: a stored member has them as they are.
    """
    why, size = "", len(data)
    while at < size:
        try:
            found, end, whole = _take(data, at)
            if not (had and at < until and not found[0].compressed and any(isinstance(x, Record) and (x.headers, x.block) == (found[0].headers, found[0].block) for x in had)):
                return at, found, end, whole, why
            at = end
        except Damaged as e:
            why = why or str(e)
            start = _START.search(data, at + 1)
            at = start.start() if start else size
    return size, [], size, True, why


def salvage(data) -> Iterator[Record | Gap]:
    """Records and gaps of an archive (bytes or a memory map) in order; together they cover it.

    All that comes from one member has the member's offset and length; a damaged member reaches to where the reader takes up again.
    """
    at, size = 0, len(data)
    begin, found, end, whole, why = _next(data, 0)
    while at < size:
        if begin > at:
            yield Gap(at, begin - at, why)
        following = None if whole else _next(data, begin + 1, found, end)
        at = following[0] if following else end
        if at < end:  # it was read on into what follows
            try:
                found = _take(data, begin, at)[0]
            except Damaged as e:
                found = [Gap(0, 0, str(e))]
        for x in found:
            x.offset, x.length = begin, at - begin
            yield x
        begin, found, end, whole, why = following or _next(data, at)


ROWS = "archive string, kind string, begin long, length long, reason string, record_id string, warc_type string, uri string, block binary"


def _rows(batches: Iterable[pa.RecordBatch], opened) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for k in range(b.num_rows):
            name = b.column(0)[k].as_py()
            data = opened(b, k)
            for x in salvage(data) if data is not None else ():
                if isinstance(x, Gap):
                    reason = x.reason if x.inside is None else f"{x.reason}, inflated bytes {x.inside[0]} to {sum(x.inside)}"
                    rows.append((name, "gap", x.offset, x.length, reason, None, None, None, None))
                else:
                    h = x.headers
                    rows.append((name, "record", x.offset, x.length, x.reason or None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), x.block))
                    held += len(x.block)
                if held > 8 << 20 or len(rows) >= 4096:
                    yield batch()
                    rows, held = [], 0
    if rows:
        yield batch()


def salvage_archives(df: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Records and gaps of a table of archives, such as ``spark.read.format("binaryFile")`` gives.

    Rows of kind ``record`` have the record's id, type, target and block; rows of kind ``gap`` the
    first check that failed, and in a member that isn't lost as a whole which of the inflated bytes.
    ``begin`` and ``length`` are bytes of the archive.  A record has a reason if its member failed a
    check: its block is right by its digest (or whole, if the member is only truncated), its headers may not be.  A null or empty archive
    has neither; archives that are repeated are read each; other columns aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, lambda b, k: b.column(1)[k].as_py())

    return picked(df, archive=name_col, content=content_col).withColumn("archive", F.col("archive").cast("string")).mapInArrow(run, ROWS)


def salvage_files(df: DataFrame, path_col: str = "path") -> DataFrame:
    """``salvage_archives`` of a table of paths that all executors can open: a local path is mapped into memory, not read whole."""

    def opened(b: pa.RecordBatch, k: int):
        import mmap
        import os

        path = b.column(0)[k].as_py()
        if path is None:
            return None
        path = path.removeprefix("file://").removeprefix("file:")
        if "://" in path:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as f:
                return f.read()
        if not os.path.getsize(path):
            return None
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(batches, opened)

    return picked(df, archive=path_col).select(F.col("archive").cast("string").alias("archive")).mapInArrow(run, ROWS)


#: How the archives of ``page_archives`` are damaged, by the first byte of the MD5 of a page's URL.
FLIPPED, CUT, JUNK, MISCOUNTED, PLAIN = range(0, 8), range(8, 16), range(16, 24), range(24, 32), range(32, 64)


def page_record(page_id: int | None, url: str | None, html: str | None, damage: bool = True) -> bytes:
    """One page as a record of an archive, most of them gzip members; its URL decides whether and how it is damaged."""
    kind = hashlib.md5((url or "").encode()).digest()[0] if damage else 255
    headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI": " ".join((url or "").split()), "Content-Type": "text/html"}
    plain = record_bytes(headers, (html or "").encode())
    if kind in MISCOUNTED:
        return plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1)
    if kind in PLAIN:
        return plain
    out = bytearray(member(plain))
    if kind in FLIPPED:
        out[len(out) // 2] ^= 0x55
    elif kind in CUT:
        out = out[: len(out) * 2 // 3]
    elif kind in JUNK:
        out[:0] = b"\x00junk\x1f\x8b\x08\x00WARC/1.0\r\n" * 3
    return bytes(out)


def page_archives(pages: DataFrame, each: int = 64) -> DataFrame:
    """(path, content): pages packed into archives of ``each``, in place, with the damage that ``page_record`` does."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, each):
                rows = b.slice(at, each).to_pylist()
                body = b"".join(page_record(r["page_id"], r["url"], r["html"]) for r in rows)
                yield pa.RecordBatch.from_arrays([pa.array([f"pages-{rows[0]['page_id']}.warc.gz"]), pa.array([body], pa.binary())], names=["path", "content"])

    return rows_of(pages, "page_id", url="url", html="html").withColumnRenamed("id", "page_id").mapInArrow(run, "path string, content binary")


def salvaged_pages(pages: DataFrame) -> DataFrame:
    """Pages through damaged archives and back: (archive, kind, begin, length, reason, page_id, url, html).

    Each page that isn't in a gap comes back whole, however long; one with a null or empty URL or text has
    them empty, one with a null id a null id; rows that are repeated come back each; an empty table gives
    an empty result.  Ids must be integers; other columns, whatever their names, aren't read.
    """
    rows = salvage_archives(page_archives(pages))
    page = F.regexp_extract("record_id", r"^<urn:page:(\d+)>$", 1)
    return rows.select("archive", "kind", "begin", "length", "reason", F.when(page != "", page.cast("long")).alias("page_id"), F.col("uri").alias("url"), F.decode("block", "UTF-8").alias("html"))
