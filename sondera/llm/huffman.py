"""Token ids as binary: canonical length-limited Huffman codes from global counts.

The counts of all ids over the whole table give the code lengths (package-merge, so they are the
best under the limit); the canonical code is known from the lengths alone.  Each document's ids are
packed by themselves, in blocks of up to ``BLOCK`` ids, and a block has the bit offset of every
``STRIDE``-th id, so that any stretch can be decoded without what is before it.  The decoder looks up
``limit`` bits in one table, and goes through all stretches of a batch in step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, rows_of
from .bpe import spread

BLOCK, STRIDE, LIMIT = 65536, 512, 20
MOST_BITS = 24  # a code and a started byte fit into the 32 bits that are read at once


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of at most ``limit`` bits by package-merge; the limit grows if there are too many symbols for it."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    if limit > MOST_BITS:
        raise ValueError(f"{n} different ids need codes of over {MOST_BITS} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    taken, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):  # from the longest code up
        merged = np.concatenate([coins, packages])
        rank = np.argsort(merged, kind="stable")
        taken.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    # the first 2n-2 items of the last list are chosen; the packages among them choose twice as many of the list before
    lengths, want = np.zeros(n, np.int64), 2 * n - 2
    for is_coin in reversed(taken):
        singles = int(is_coin[:want].sum())
        lengths[:singles] += 1
        want = 2 * (want - singles)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Codebook:
    """Ids in canonical order (shorter codes first, then smaller ids), with lengths and codes."""

    ids: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    _table: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # each process makes its own

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, limit: int = LIMIT) -> Codebook:
        return cls.canonical(np.asarray(ids, np.int64), code_lengths(np.asarray(counts), limit))

    @classmethod
    def canonical(cls, ids: np.ndarray, lengths: np.ndarray) -> Codebook:
        if not len(ids):
            return cls(ids, lengths, np.zeros(0, np.int64))
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        codes, code, last = np.zeros(len(ids), np.int64), 0, int(lengths[0])
        starts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            code <<= int(lengths[a]) - last
            last = int(lengths[a])
            codes[a:b] = code + np.arange(b - a)
            code += int(b - a)
        return cls(ids, lengths, codes)

    @property
    def bits(self) -> int:
        return int(self.lengths[-1]) if len(self.lengths) else 0

    def encode(self, ids: np.ndarray, blocks: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packs ``ids``, cut into blocks at the offsets ``blocks``: bytes, each block's first byte, its bits, the bit offset of each id in its block.

        An id that isn't in the code is a ValueError.
        """
        by_id = np.argsort(self.ids)
        if len(ids):
            at = by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=by_id), len(by_id) - 1)] if len(by_id) else np.zeros(len(ids), np.int64)
            unknown = self.ids[at] != ids if len(by_id) else np.ones(len(ids), bool)
            if unknown.any():
                raise ValueError(f"id {int(ids[np.argmax(unknown)])} isn't in the code: it must come from counts of all ids to be packed")
        else:
            at = np.zeros(0, np.int64)
        size, code = self.lengths[at], self.codes[at]
        total = np.append(0, np.cumsum(size))
        bits = np.diff(total[blocks])
        first = np.append(0, np.cumsum((bits + 7) // 8))
        within = total[:-1] - np.repeat(total[blocks[:-1]], np.diff(blocks))
        place = within + 8 * np.repeat(first[:-1], np.diff(blocks))
        out = np.zeros(int(first[-1]) + 4, np.uint8)
        if len(ids):
            byte = place >> 3
            value = (code << (32 - size - (place & 7))).astype(np.uint32)
            runs = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            value, byte = np.bitwise_or.reduceat(value, runs), byte[runs]
            for lane in range(4):
                out[byte + lane] |= (value >> np.uint32(24 - 8 * lane)).astype(np.uint8)
        return out[: int(first[-1])], first, bits, within

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for each value of the next ``bits`` bits."""
        span = 1 << (self.bits - self.lengths)
        rest = (1 << self.bits) - int(span.sum())
        return np.append(np.repeat(self.ids, span), np.zeros(rest, np.int64)).astype(np.int32), np.append(np.repeat(self.lengths, span), np.zeros(rest, np.int64)).astype(np.uint8)

    def decode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of stretches that begin at the bits ``starts`` and have ``sizes`` ids, one after the other."""
        out = np.zeros(int(sizes.sum()), np.int64)
        if not len(out):
            return out
        if self._table is None:
            self._table = self.table()
        symbols, lengths = self._table
        padded = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
        window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
        order = np.argsort(-sizes, kind="stable")
        place, left, to = starts[order].copy(), sizes[order], (np.cumsum(sizes) - sizes)[order]
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        for step in range(int(left[0])):
            live = int(np.searchsorted(-left, -step, "left"))  # stretches with more than ``step`` ids
            p = place[:live]
            look = ((window[p >> 3].astype(np.int64) << (p & 7)) >> shift) & mask
            out[to[:live] + step] = symbols[look]
            place[:live] = p + lengths[look]
        return out


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        own = b.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
        if len(own) and own.min() >= 0 and own.max() < 1 << 21:
            n = np.bincount(own)
            ids = np.flatnonzero(n)
            n = n[ids]
        else:
            ids, n = np.unique(own, return_counts=True)
        both = np.concatenate([known, ids])
        known, back = np.unique(both, return_inverse=True)
        count = np.bincount(back, np.concatenate([count, n]), len(known)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(count)], names=["id", "n"])


def codebook(df: DataFrame, ids_col: str = "token_ids", limit: int = LIMIT) -> Codebook:
    """The code from the counts of all ids of the column; null lists and null ids don't count.  As large as the vocabulary."""
    each = picked(df, ids=ids_col).mapInArrow(_counts, "id long, n long")
    found = each.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    return Codebook.of(found.column("id").to_numpy(), found.column("n").to_numpy(), limit)


def _blocks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row and offset of each block; an empty row has one block of nothing."""
    count = np.maximum(1, -(-sizes // most))
    row = np.repeat(np.arange(len(sizes)), count)
    number = spread(np.zeros(len(sizes), np.int64), count)
    length = np.minimum(most, sizes[row] - number * most)
    return row, number, np.append(0, np.cumsum(length))


def huffman_encode(df: DataFrame, book: Codebook, id_col: str = "doc_id", ids_col: str = "token_ids", block: int = BLOCK, stride: int = STRIDE, check: bool = True) -> DataFrame:
    """(doc_id, block, n_tokens, n_bits, checkpoints, data, decoded): one row for each block of each row of ``df``.

    ``checkpoints`` has the bit offset of each ``stride``-th id of the block; ``decoded``: the block,
    decoded from its checkpoints, gave its ids again (left out without ``check``).  Empty and null
    lists have one block of no ids, with null ``data`` for null; null ids within a list are left
    out; a list of any length is packed whole, in as many blocks as it needs; a null doc_id stays null and
    repeated rows are packed each; an empty table gives an empty result.  An id that isn't in ``book`` fails the
    query with a ValueError that names it.  Doc ids must be integers; other columns aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _pack(b, book, block, stride, check)

    rows = rows_of(df, id_col, ids=ids_col)
    return rows.mapInArrow(run, "doc_id long, block int, n_tokens long, n_bits long, checkpoints array<long>, data binary" + ", decoded boolean" * check)


def _pack(b: pa.RecordBatch, book: Codebook, most: int, stride: int, check: bool, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch, about ``at_once`` ids at a time, which bounds the memory."""
    lists = b.column(1)
    flat = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if flat.null_count:
        real = flat.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(real))[np.append(0, np.cumsum(sizes))]
        flat, sizes = flat.drop_null(), np.diff(ends)
    every = flat.to_numpy(zero_copy_only=False)
    rows, numbers, cuts = _blocks(sizes, most)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + at_once, "right")) - 1)
        yield _packed(b.column(0), lists, rows[lo:hi], numbers[lo:hi], cuts[lo : hi + 1] - cuts[lo], every[cuts[lo] : cuts[hi]], book, stride, check)
        lo = hi


def _packed(doc_ids: pa.Array, lists: pa.Array, row: np.ndarray, number: np.ndarray, cut: np.ndarray, ids: np.ndarray, book: Codebook, stride: int, check: bool) -> pa.RecordBatch:
    data, first, bits, within = book.encode(ids, cut, stride)
    length = np.diff(cut)
    marks = -(-length // stride)
    mark_at = np.repeat(cut[:-1], marks) + stride * spread(np.zeros(len(marks), np.int64), marks)
    offsets = within[mark_at]
    packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    null = lists.is_null().take(pa.array(row))
    columns = [
        doc_ids.take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(length), pa.array(bits),
        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(marks)).astype(np.int32)), pa.array(offsets, pa.int64())),
        pc.if_else(null, pa.scalar(None, pa.binary()), packed),
    ]
    names = ["doc_id", "block", "n_tokens", "n_bits", "checkpoints", "data"]
    if check:
        stretch = np.minimum(stride, np.repeat(cut[1:], marks) - mark_at)
        back = book.decode(data, offsets + 8 * np.repeat(first[:-1], marks), stretch)
        wrong = np.append(0, np.cumsum(back != ids))
        columns.append(pa.array(wrong[cut[1:]] == wrong[cut[:-1]]))
        names.append("decoded")
    return pa.RecordBatch.from_arrays(columns, names=names)


def huffman_decode(df: DataFrame, book: Codebook, stride: int = STRIDE) -> DataFrame:
    """(doc_id, block, token_ids) of the rows of ``huffman_encode``; each block by itself, null ``data`` gives null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(4).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
            data = np.frombuffer(packed.buffers()[2], np.uint8) if packed.buffers()[2] is not None else np.zeros(0, np.uint8)
            marks = b.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column(2).to_numpy()
            size = np.minimum(stride, np.repeat(n, marks) - stride * spread(np.zeros(len(marks), np.int64), marks))
            ids = book.decode(data, b.column(3).flatten().to_numpy(zero_copy_only=False) + 8 * np.repeat(offsets[:-1], marks), size)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.if_else(b.column(4).is_null(), pa.scalar(None, lists.type), lists)], names=["doc_id", "block", "token_ids"])

    return df.select("doc_id", "block", "n_tokens", "checkpoints", "data").mapInArrow(run, "doc_id long, block int, token_ids array<int>")
