"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature.  The first, sigma, scatters a shingle's hash over the
positions of a circle; the second, pi, is one table of ranks round that circle.  Coordinate ``k``
of the signature is the least rank among a document's positions with pi turned by ``k`` places, so
that a shingle's ranks for all coordinates lie side by side in the table: a signature is a
coordinate-wise minimum of contiguous slices.

Documents that agree in a band are candidates.  In each bucket all are first held against the
bucket's least id, which joins a bucket of many copies into one group by as many comparisons as it has
documents.  For those buckets whose documents that hasn't joined into one group, the pairs of different
groups are compared by their signatures, block by block, so that no pair is written down but those whose
signatures can belong to a pair above the threshold (``LEEWAY`` deviations below it); these are
verified.  Since pairs within one group can't change it, the groups are those of the graph of all
verified candidate pairs: no link between different groups is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import by_place, discard, rows_of, whole, written
from .components import components
from .textvec import mix, shingles, token_hashes

#: Positions of the circle, words of a shingle, bands and rows: at a Jaccard of 0.5 a pair shares a band with probability 0.92, at 0.6 0.996.
#: One changed word changes three shingles: at 0.5 a tenth of the words may differ.
CIRCLE, SHINGLE, BANDS, ROWS, THRESHOLD = 1 << 20, 3, 40, 4, 0.5
#: Documents of a bucket that are compared with as many others in one go; deviations of the signatures' agreement.
BLOCK, LEEWAY = 4096, 5.0
_tables: dict[tuple[int, int], np.ndarray] = {}


def circle(size: int, turns: int) -> np.ndarray:
    """pi as ranks, so laid out that the window of ``turns`` ranks at position p is pi turned by 0, 1, ... places at p."""
    if (size, turns) not in _tables:
        ranks = np.random.default_rng(20_240_229).permutation(size).astype(np.uint32)
        _tables[size, turns] = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:turns]]), turns)
    return _tables[size, turns]


def signatures(hashes: np.ndarray, offsets: np.ndarray, turns: int, size: int = CIRCLE) -> np.ndarray:
    """One row of ``turns`` coordinates for each document; a document without shingles has the largest rank throughout."""
    windows = circle(size, turns)
    place = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)
    out = np.full((len(offsets) - 1, turns), np.iinfo(np.uint32).max, np.uint32)
    for k in range(len(offsets) - 1):
        own = place[offsets[k] : offsets[k + 1]]
        for at in range(0, len(own), 4096):  # bounds the copy of a long document's windows
            np.minimum(out[k], windows[own[at : at + 4096]].min(axis=0), out=out[k])
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def _bands(bands: int, rows: int, k: int):
    """(key, id): a document's buckets, one for each band.

    Of documents of one partition with the same shingles only the first goes to its bands; the others share
    one bucket with it, where they are verified like any candidates.  So a document with very many copies
    fills no bucket with all of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, bool]] = {}  # first document, whether it is in the bucket of its copies
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, hashes, offsets, _ in token_hashes(b.column(1)):
                own, cuts = shingles(hashes, offsets, k)
                new, first, copies = [], [], []
                for row in np.flatnonzero(np.diff(cuts)).tolist():
                    digest = hashlib.blake2b(own[cuts[row] : cuts[row + 1]], digest_size=16).digest()
                    found = known.get(digest)
                    if found is None:
                        known[digest] = int(ids[lo + row]), False
                        new.append(row)
                        continue
                    if not found[1]:
                        known[digest] = found[0], True
                        first.append(found[0])
                        copies.append(found[0])
                    first.append(found[0])
                    copies.append(int(ids[lo + row]))
                keys, who = [mix(np.array(first, np.int64).view(np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)], [np.array(copies, np.int64)]
                if new:
                    size = np.diff(cuts)[new]
                    kept = own[np.repeat(cuts[new] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    keys.append(band_keys(signatures(kept, np.append(0, np.cumsum(size)), bands * rows), bands).ravel())
                    who.append(np.repeat(ids[lo:hi][new], bands))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(who))], names=["key", "id"])

    return run


def _signed(turns: int, k: int):
    """(id, signature): the low byte of each coordinate; by chance one in 256 agrees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, hashes, offsets, _ in token_hashes(b.column(1)):
                own, cuts = shingles(hashes, offsets, k)
                low = (signatures(own, cuts, turns) & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "signature"])

    return run


def _alike(threshold: float, turns: int):
    """Of rows (key, i, j, block, id, comp, leader, signature), sorted: the pairs of blocks i and j that may reach the threshold."""
    least = threshold * turns - LEEWAY * np.sqrt(turns * threshold * (1 - threshold))

    def pairs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        i, j, block, ids, comp, leader = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(1, 7))
        sign = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(len(ids), turns)
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        found_a, found_b = [], []
        for row in left:
            others = right[(comp[right] != comp[row]) & ((ids[right] > ids[row]) if i[0] == j[0] else True)]
            near = others[(sign[others] == sign[row]).sum(axis=1) >= least]
            near = near[np.minimum(ids[near], ids[row]) != leader[row]]  # those are verified already
            found_a.append(np.minimum(ids[near], ids[row]))
            found_b.append(np.maximum(ids[near], ids[row]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + found_a), np.concatenate(none + found_b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None
        for b in batches:
            b = b if left is None else pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            same = np.ones(b.num_rows - 1, bool)
            for c in range(3):
                x = b.column(c).to_numpy()
                same &= x[1:] == x[:-1]
            cuts = np.append(0, np.flatnonzero(~same) + 1)
            out = [pairs(b.slice(int(p), int(q - p))) for p, q in zip(cuts, cuts[1:], strict=False)]
            left = b.slice(int(cuts[-1]))
            if out:
                yield _edges(out)
        if left is not None:
            yield _edges([pairs(left)])

    return run


def _edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["a", "b"])


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, hashes, offsets, _ in token_hashes(column):
        own, cuts = shingles(hashes, offsets, k)
        out += [np.unique(own[cuts[i] : cuts[i + 1]]) for i in range(hi - lo)]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets without repeats; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) of at least that Jaccard similarity."""
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(threshold, k), "a long, b long, jaccard double")


def _compare(threshold: float, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounds what the sets hold at once
                part = b.slice(at, 512)
                value = np.array([jaccard(x, y) for x, y in zip(_sets(part.column(2), k), _sets(part.column(3), k), strict=True)])
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value)], names=["a", "b", "jaccard"])
                yield out.filter(pa.array(value >= threshold))

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, dup_of) for every document but the one of least id in each group of near-duplicates.

    ``dup_of`` is the group: two documents of a verified pair always have the same, however many copies
    there are.  Shingles are ``k`` successive tokens of ``textvec`` in lower case (ASCII) over the whole text,
    however long, so equal token sequences are near-duplicates whatever stands between the tokens.  A
    document with a null id, or without a token, is in no group; one of fewer than ``k`` tokens has one
    shingle of all of them.  Rows that repeat an id are one document if their texts are equal; if the texts
    differ, the id is near whatever one of them is near.  Ids must be integers; other columns, whatever
    their names, aren't read; an empty table gives an empty result.
    """
    docs = rows_of(df, id_col, text=text_col).where("id is not null and text is not null")
    in_key = W.partitionBy("key")
    buckets = docs.mapInArrow(_bands(bands, rows, k), "key long, id long").withColumn("leader", F.min("id").over(in_key))
    # a bucket of one id is no bucket
    shared = written(buckets.withColumn("last", F.max("id").over(in_key)).where("leader <> last").select("key", "id", "leader"), "buckets")
    ids = shared.select("id").distinct()
    texts = written(docs.join(ids.hint("shuffle_hash"), "id", "left_semi").distinct(), "candidates")
    star = shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    edges = written(_verified(star, texts, threshold, k), "verified")
    groups = components(edges)
    # what is left: buckets with documents of more than one group, and there the pairs of different groups
    grouped = shared.join(groups, "id", "left").select("key", "id", "leader", F.coalesce("comp", "id").alias("comp"))
    mixed = grouped.withColumn("least", F.min("comp").over(in_key)).withColumn("most", F.max("comp").over(in_key)).where("least <> most")
    at = mixed.withColumn("block", F.expr(f"cast((row_number() over (partition by key order by id) - 1) div {BLOCK} as int)"))
    mixed = written(at.select("key", "id", "leader", "comp", "block", F.max("block").over(in_key).alias("last")), "mixed")
    signed = texts.join(mixed.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").mapInArrow(_signed(bands * rows, k), "id long, signature binary")
    met = mixed.withColumn("other", F.explode(F.expr("sequence(0, last)"))).join(signed, "id")
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "leader", "signature")
    rest = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_alike(threshold, bands * rows), "a long, b long").distinct()
    more = written(_verified(rest, texts, threshold, k), "verified")
    discard(mixed)
    all_edges = edges.select("a", "b").unionAll(more.select("a", "b"))
    groups = groups if more.isEmpty() else components(all_edges)
    for t in (shared, texts, edges, more):
        discard(t)
    return groups.where("id <> comp").select(F.col("id").alias("doc_id"), F.col("comp").alias("dup_of"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``df`` without the documents of ``near_duplicates``: of each group the one of least id stays, with all columns, whatever their names.

    Rows with a null id stay, as do those with a null or empty text; rows that repeat an id stay or go
    together; an empty table stays empty.
    """
    gone = near_duplicates(df, id_col, text_col, **parameters).select(F.col("doc_id").alias("gone"))
    rows = by_place(df)
    return rows.join(gone, rows[f"c{whole(df, id_col)}"].cast("long") == gone["gone"], "left_anti").toDF(*df.columns)
