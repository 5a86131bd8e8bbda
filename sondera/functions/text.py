"""Text segmentation and predicates.  "Alphanumeric" is ASCII only; offsets are bytes of UTF-8, half-open."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE, WORD = ".!?\n", '.!?\n, ();":'
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_JUNK = bytes(b for b in range(256) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
CORE = "(?s)[A-Za-z0-9](?:.*[A-Za-z0-9])?"
SPAN = "array<struct<pos:int,start_i:bigint,end_i:bigint,contents:string,type:string>>"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def whitespace_only(s: Column) -> Column:
    return s.rlike("^[ \\t\\n\\r\\x0B\\f]*\\z")


def wordlike(s: Column) -> Column:
    """At least two ASCII letters or digits."""
    return F.length(F.regexp_replace(s, "[^A-Za-z0-9]", "")) >= 2


def strip(s: Column) -> Column:
    """From the first to the last ASCII letter or digit; "" if there is none."""
    return F.regexp_extract(s, CORE, 0)


def strip_query(q: Column) -> Column:
    """As ``strip``, but a query whose first letter or digit is its last byte is empty."""
    return F.when(q.rlike("(?s)^[^A-Za-z0-9]*[A-Za-z0-9]\\z"), F.lit("")).otherwise(strip(q))


def strip_query_text(q: str) -> str:
    """``strip_query`` of a Python string."""
    found = re.search(r"[A-Za-z0-9](?s:.*[A-Za-z0-9])?", q)
    if not found or (found.end() - found.start() == 1 and found.end() == len(q)):
        return ""
    return found[0]


def _class(delimiters: str) -> str:
    return "".join("\\n" if c == "\n" else re.escape(c) for c in delimiters)


def chunks(s: Column, delimiters: str = SENTENCE) -> Column:
    """The stripped, non-empty chunks of a text in order, without offsets: inside the JVM, in one row.

    A chunk ends at a delimiter; a URL (``http://`` or ``https://``, at any place) is one chunk up to a
    space, newline or tab.
    """
    d = _class(delimiters)
    tiles = F.regexp_extract_all(s, F.lit(f"https?://[^ \\n\\t]*|(?:(?!https?://)[^{d}])++"), F.lit(0))
    return F.filter(F.transform(tiles, strip), lambda c: c != "")


def scan(text: bytes, delimiters: str = SENTENCE) -> Iterator[tuple[int, int, bool]]:
    """Byte offsets of the chunks of a text, and whether each is a URL."""
    plain, full = _patterns(delimiters)
    for m in (full if b"http" in text else plain).finditer(text):
        tile = m[0]
        core = tile.lstrip(_JUNK)
        start = m.start() + len(tile) - len(core)
        core = core.rstrip(_JUNK)
        if core:
            yield start, start + len(core), tile.startswith((b"http://", b"https://"))


_compiled: dict[str, tuple[re.Pattern, re.Pattern]] = {}


def _patterns(delimiters: str) -> tuple[re.Pattern, re.Pattern]:
    if delimiters not in _compiled:
        d = _class(delimiters).encode()
        _compiled[delimiters] = re.compile(b"[^" + d + b"]+"), re.compile(b"https?://[^ \\n\\t]*|(?:[^h" + d + b"]++|h(?!ttps?://))++")
    return _compiled[delimiters]


class Chunks:
    """The chunks of some texts as arrays: ``row`` of the text, ``pos`` in it, ``start``, ``end`` in bytes, ``url``, ``letters`` (how many letters and digits)."""

    def __init__(self, texts: pa.Array, delimiters: str):
        data, offsets = text_bytes(texts)
        kind = _table(delimiters)[data]
        at = np.flatnonzero(kind == 1)
        ends = (kind == 2).astype(np.int32)
        ends[offsets[offsets < len(data)]] += 1
        tile = np.cumsum(ends)[at]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = tile[1:] != tile[:-1]
        bounds = np.flatnonzero(new) if len(at) else np.zeros(1, int)
        first, last = bounds[:-1], bounds[1:] - 1
        row = np.searchsorted(offsets, at[first], "right") - 1
        self.row, self.start, self.end, self.letters = row, at[first], at[last] + 1, bounds[1:] - bounds[:-1]
        self.url = np.zeros(len(first), bool)
        if linked := _linked(data, offsets):
            self._replace(data, offsets, linked, delimiters)
        begins = np.searchsorted(self.row, np.arange(len(texts)))
        self.pos = np.arange(len(self.row)) - begins[self.row]
        self.counts = np.diff(np.append(begins, len(self.row)))
        self._data, self._at = data, (self.start, self.end)
        self.start, self.end = self.start - offsets[self.row], self.end - offsets[self.row]

    def _replace(self, data: np.ndarray, offsets: np.ndarray, linked: list[int], delimiters: str) -> None:
        """Texts that may have a URL are scanned one by one."""
        found: list[tuple[int, int, int, bool, int]] = []
        for k in linked:
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            found += [(k, offsets[k] + a, offsets[k] + b, url, len(text[a:b].translate(None, _JUNK))) for a, b, url in scan(text, delimiters)]
        keep = ~np.isin(self.row, linked)
        more = np.array(found, np.int64).reshape(-1, 5).T
        row, start, end, url, letters = (np.concatenate([x[keep], y.astype(x.dtype)]) for x, y in zip((self.row, self.start, self.end, self.url, self.letters), more, strict=True))
        order = np.argsort(row, kind="stable")
        self.row, self.start, self.end, self.url, self.letters = row[order], start[order], end[order], url[order], letters[order]

    def contents(self, some: np.ndarray | None = None) -> pa.Array:
        """The texts of the chunks, or of those of the given numbers."""
        start, end = self._at if some is None else (x[some] for x in self._at)
        size = end - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self._data[where]))

    def types(self, some: np.ndarray | None = None) -> pa.Array:
        url = self.url if some is None else self.url[some]
        return pa.DictionaryArray.from_arrays(pa.array(url.astype(np.int8)), pa.array(["string", "url"])).cast(pa.string())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins, with the end; a null has none."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8) if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(whole) and whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _table(delimiters: str) -> np.ndarray:
    """For each byte 1 if it is a letter or digit, 2 if a delimiter."""
    if delimiters not in _tables:
        table = np.ones(256, np.uint8)
        table[list(_JUNK)] = 0
        table[list(delimiters.encode())] = 2
        _tables[delimiters] = table
    return _tables[delimiters]


_tables: dict[str, np.ndarray] = {}


def alphanumeric(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a letter or digit."""
    return _table("")[data] == 1


def _linked(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """The texts in which ``http`` occurs."""
    at = [m.start() for m in re.finditer(b"http", memoryview(data))]
    rows = np.unique(np.searchsorted(offsets, at, "right") - 1) if at else []
    return [int(k) for k in rows]


#: Bytes of text, about, that are split at once.
SLICE = 1 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, after last) of runs of texts, each of ``most`` bytes at most or a single text."""
    size = np.nan_to_num(pc.binary_length(texts).cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        until = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + most, "right")))
        yield at, until
        at = until


def spans(s: Column, delimiters: str = SENTENCE) -> Column:
    """The chunks with their positions and byte offsets, as an array of structs; linear in the text's length.

    Running byte offsets have no built-in form that is linear in a row or needs no shuffle, so this
    one goes over the Arrow buffer of the text column.  A null text gives null.  ``span_rows`` has the same as rows.
    """

    @F.arrow_udf(SPAN)
    def split(column: pa.Array) -> pa.Array:
        parts = []
        for at, until in slices(column):
            texts = column.slice(at, until - at)
            c = Chunks(texts, delimiters)
            fields = [pa.array(c.pos.astype(np.int32)), pa.array(c.start), pa.array(c.end), c.contents(), c.types()]
            items = pa.StructArray.from_arrays(fields, names=["pos", "start_i", "end_i", "contents", "type"])
            offsets = np.concatenate([[0], np.cumsum(c.counts)]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), items, mask=texts.is_null()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("pos", pa.int32()), ("start_i", pa.int64()), ("end_i", pa.int64()), ("contents", pa.string()), ("type", pa.string())])))

    return split(s)


def span_rows(df: DataFrame, text: Column, *keys: str, delimiters: str = SENTENCE, least: int = 1, drop: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, start_i, end_i, contents, type), without those in ``drop``: a row for each chunk of ``least`` letters or digits at least.

    Some ``SLICE`` bytes of text are split at once and some thousand rows sent on, so memory doesn't depend on how long the
    texts of a batch are together.
    """
    fields = [f for f in T._parse_datatype_string("pos int, start_i long, end_i long, contents string, type string").fields if f.name not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, until in slices(b.column(len(keys))):
                part = b.slice(first, until - first)
                c = Chunks(part.column(len(keys)), delimiters)
                kept = np.flatnonzero(c.letters >= least)
                for at in range(0, len(kept), 16384):
                    some = kept[at : at + 16384]
                    own = {"pos": lambda: pa.array(c.pos[some].astype(np.int32)), "start_i": lambda: pa.array(c.start[some]), "end_i": lambda: pa.array(c.end[some]), "contents": lambda: c.contents(some), "type": lambda: c.types(some)}  # noqa: B023
                    of = pa.array(c.row[some])
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in range(len(keys))), *(own[f.name]() for f in fields)], names=[*keys, *(f.name for f in fields)])

    rows = df.select(*keys, text.alias("_text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *fields]))


def sentences(s: Column) -> Column:
    return spans(s, SENTENCE)


def words(s: Column) -> Column:
    return spans(s, WORD)
