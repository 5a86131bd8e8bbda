"""Exact deduplication by distributed most-significant-digit radix partitioning.

A document is a string of digits: its length in bytes (where it ends), then its bytes in order.  The
cluster splits on the length and the leading ``HEAD`` bytes by one shuffle.  Groups that hold over
``BOUND`` bytes are split again by the cluster, on ``FACTOR`` times as many leading bytes, and so on
until they are small or their documents have ended.  A small group is split by its next bytes within
one task, until it is a single document or its documents have ended.  Documents that end together in
one group are equal; no digest is compared.  A large group that has ended is never brought
together: only its least id is looked for, by partial aggregates.

Before a shuffle every batch is split in the same way by itself, so that of a document with very
many copies only one for each batch travels.  A task holds no more than the texts of one small group
and a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, discard, place, rows_of, whole, written

#: Leading bytes by which the cluster splits first, by how many times more it splits large groups again, and the bytes of a small group.
HEAD, FACTOR, BOUND = 64, 16, 64 << 20


def radix_split(texts: list[bytes], depth: int = 0) -> Iterator[list[int]]:
    """The groups of two or more equal texts, as positions, each in order.

    The digit grows from 8 bytes to 64 KB as the depth grows, so that the passes over a long
    document are few; digits are ordered and compared byte by byte.
    """
    by_end: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        by_end.setdefault(len(t), []).append(k)
    stack = [(group, depth, end) for end, group in by_end.items()]
    while stack:
        group, at, end = stack.pop()
        if len(group) < 2:
            continue
        if at >= end:
            yield group
            continue
        width = min(max(8, at), 65536)
        digits = sorted((texts[k][at : at + width], k) for k in group)
        run = [digits[0][1]]
        for (before, _), (digit, k) in zip(digits, digits[1:], strict=False):
            if digit != before:
                stack.append((run, at + width, end))
                run = []
            run.append(k)
        stack.append((run, at + width, end))


def _owners(texts: pa.Array, known: np.ndarray, depth: int) -> np.ndarray:
    """For each row the first row with an equal text; ``known`` numbers the groups made so far."""
    n = len(texts)
    owner = np.arange(n)
    order = np.argsort(known, kind="stable")
    cuts = np.flatnonzero(np.append(True, known[order][1:] != known[order][:-1])) if n else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], n), strict=True):
        if b - a > 1:
            rows = order[a:b]
            for group in radix_split([texts[int(r)].as_py() or b"" for r in rows], depth):
                owner[rows[group]] = rows[group[0]]
    return owner


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a batch, with the ids of all its documents."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, text = b.column(0), b.column(1)
        owner = _owners(text, b.column(2).to_numpy(zero_copy_only=False), 0)
        order = np.argsort(owner, kind="stable")
        kept, count = np.unique(owner, return_counts=True)
        members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), ids.take(pa.array(order)))
        rest = b.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([members, *rest.columns[1:]], names=["ids", "text", "size", "head"])


def _runs(batches: Iterable[pa.RecordBatch], size: int, head: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal (size, head), which are the small groups."""
    left: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if left is not None:
            t = pa.concat_tables([left, t]).combine_chunks()
        ends = _breaks(t, size, head)
        if len(ends) == 0:
            left = t
            continue
        yield t.slice(0, int(ends[-1]))
        left = t.slice(int(ends[-1])).combine_chunks()
    if left is not None and left.num_rows:
        yield left


def _breaks(t: pa.Table, size: int, head: int) -> np.ndarray:
    """Rows at which another run begins, without row 0."""
    s, h = t.column(size), t.column(head)
    new = pc.or_(pc.not_equal(s.slice(1), s.slice(0, len(s) - 1)), pc.not_equal(h.slice(1), h.slice(0, len(h) - 1)))
    return np.flatnonzero(new.to_numpy()) + 1


def _known(t: pa.Table, size: int, head: int) -> np.ndarray:
    known = np.zeros(t.num_rows, np.int64)
    known[_breaks(t, size, head)] = 1
    return np.cumsum(known)


def _pairs(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2, 3):
            owner = _owners(t.column(1).combine_chunks(), _known(t, 2, 3), depth)
            count = pc.list_value_length(t.column(0)).to_numpy(zero_copy_only=False)
            some = np.flatnonzero((count > 1) | (np.bincount(owner, minlength=t.num_rows)[owner] > 1))
            groups: dict[int, list] = {}
            for row, ids in zip(some, t.column(0).take(pa.array(some)).to_pylist(), strict=True):
                groups.setdefault(int(owner[row]), []).extend(ids)
            doc, of = [], []
            for ids in groups.values():
                ids.sort(key=lambda x: (x is None, x))
                doc += ids[1:]
                of += [ids[0]] * (len(ids) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(of, pa.int64())], names=["doc_id", "dup_of"])

    return run


def levels(rows: DataFrame, text: str, bound: int) -> Iterator[tuple[DataFrame, int, bool]]:
    """``rows`` in parts, each with its columns ``size`` and ``head``, the bytes that ``head`` has, and whether its groups have ended.

    The groups of a part that haven't ended have ``bound`` bytes at most, with ``HEAD`` more for each
    row; those of one that has ended consist of equal texts, and their ``head`` is the group's number.
    """
    rows, width = rows.withColumn("size", F.octet_length(text)), HEAD
    while True:
        keyed = rows.withColumn("head", F.substring(text, 1, width))
        heavy = keyed.groupBy("size", "head").agg(F.count("*").alias("n")).where(F.col("n") * (F.col("size") + HEAD) > bound)
        heavy = written(heavy.select("size", "head", F.monotonically_increasing_id().alias("number")), "heavy")
        if heavy.isEmpty():
            discard(heavy)
            yield keyed, width, False
            return
        yield keyed.join(heavy, ["size", "head"], "left_anti"), width, False
        split = written(keyed.join(heavy, ["size", "head"]).drop("head"), "split")
        yield split.where(F.col("size") <= width).withColumnRenamed("number", "head"), width, True
        rows, width = split.where(F.col("size") > width).drop("number"), width * FACTOR


def _grouped(df: DataFrame) -> DataFrame:
    """The split among the partitions: rows of one (size, head) are together."""
    return df.repartition("size", "head").sortWithinPartitions("size", "head")


def _ended_pairs(rows: DataFrame) -> DataFrame:
    """Each row of (id, head) but one, that of the least id, of every head, with that id."""
    rows = written(rows.select("id", "head", F.monotonically_increasing_id().alias("row")), "ended")
    first = rows.groupBy("head").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    return rows.join(first, "head").where("row <> first.row").select(F.col("id").alias("doc_id"), F.col("first.id").alias("dup_of"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """(doc_id, dup_of) for every document but the first, by id, of each group of byte-equal texts.

    Whole texts are compared, however long.  A null text equals nothing and is left out; empty texts equal
    one another.  A null id comes last in its group, and of a row that is repeated all but one are
    duplicates of its own id.  Ids must be integers; other columns, whatever their names, aren't read; an
    empty table gives an empty result.
    """
    rows = rows_of(df, id_col, text=text_col).where("text is not null").withColumn("text", F.col("text").cast("binary"))
    found = []
    for part, width, ended in levels(rows, "text", bound):
        if ended:
            found.append(_ended_pairs(part))
            continue
        part = part.select("id", "text", "size", "head")
        listed = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), *part.schema.fields[1:]])
        found.append(_grouped(part.mapInArrow(_combine, listed)).mapInArrow(_pairs(width), "doc_id long, dup_of long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _first_rows(batch: pa.RecordBatch | pa.Table, known: np.ndarray, depth: int, id_at: int, text_at: int) -> np.ndarray:
    text = batch.column(text_at)
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    owner = _owners(text, known, depth)
    doubtful = np.flatnonzero(np.bincount(owner, minlength=len(owner))[owner] > 1)
    keep = np.ones(len(owner), bool)
    keep[doubtful] = False
    best: dict[int, tuple] = {}
    for row, x in zip(doubtful, batch.column(id_at).take(pa.array(doubtful)).to_pylist(), strict=True):
        mark = (x is None, x if x is not None else 0, int(row))
        k = int(owner[row])
        best[k] = min(best.get(k, mark), mark)
    for _, _, row in best.values():
        keep[row] = True
    return keep


def _deduplicated(part: DataFrame, width: int, id_at: int, text_at: int) -> DataFrame:
    """The row of the least id of each text; the columns are c0, c1, ... and then size and head."""
    size = len(part.columns) - 2

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_first_rows(b, b.column(size).to_numpy(zero_copy_only=False), 0, id_at, text_at)))

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, size, size + 1):
            kept = t.filter(pa.array(_first_rows(t, _known(t, size, size + 1), width, id_at, text_at)))
            yield from kept.select(list(range(size))).combine_chunks().to_batches()

    return _grouped(part.mapInArrow(combine, part.schema)).mapInArrow(last, T.StructType(part.schema.fields[:size]))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """``df`` with one row, that of the least id, of each group of byte-equal texts; all columns stay.

    Whole texts are compared, however long.  Rows with a null text all stay, empty texts equal one another;
    a null id comes last; of a repeated row one stays; an empty table stays empty.  Ids must be integers.
    Columns of any name and type may be there, as they travel by position.
    """
    id_at, text_at = whole(df, id_col), place(df, text_col)
    names, flat = [f"c{k}" for k in range(len(df.columns))], by_place(df)
    text = names[text_at]
    rows = flat.where(F.col(text).isNotNull()).withColumn(text, F.col(text).cast("binary"))
    found = []
    for part, width, ended in levels(rows, text, bound):
        if ended:
            order = F.struct(F.col(names[id_at]).isNull(), F.col(names[id_at]).cast("long"))
            found.append(part.groupBy("head").agg(F.min_by(F.struct(*names), order).alias("first")).select("first.*"))
        else:
            found.append(_deduplicated(part.select(*names, "size", "head"), width, id_at, text_at))
    out = flat.where(F.col(text).isNull())
    for more in found:
        out = more.withColumn(text, F.col(text).cast(flat.schema[text].dataType)).unionAll(out)
    return out.toDF(*df.columns)
