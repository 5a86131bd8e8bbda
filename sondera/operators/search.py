"""Thresholded top-k similarity search over (vec_id, note_id, start_i, end_i, vec)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.vector import dot
from ..sources.shared import written

UNIQUE_CAP = 1000
TIE = 6


def literal(vec: list[float]) -> Column:
    """The vector as a constant; as one expression to parse, since a call for each component takes longer than a search."""
    if not all(map(math.isfinite, vec)):
        return F.array(*[F.lit(float(x)) for x in vec]).cast("array<float>")
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in vec)})").cast("array<float>")


def score(vectors: DataFrame, query: Column) -> DataFrame:
    """``vectors`` without the vector, with its similarity to the query."""
    return vectors.withColumn("similarity", dot(F.col("vec"), query)).drop("vec")


def top_k(scored: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k most similar rows of those above the threshold, with their rank.

    The limit comes first and the threshold after it: both are on the same key, so the rows are the
    same, and the similarity is computed once.  Null similarities (no vector) sort last and go.
    Similarities that agree to ``TIE`` decimals are ties, which go to the lesser id.
    """
    tied = F.round("similarity", TIE)
    best = scored.orderBy(tied.desc_nulls_last(), "vec_id").limit(max(k, 0)).where(F.col("similarity") > threshold)
    return best.withColumn("rank", F.row_number().over(W.orderBy(tied.desc(), "vec_id")))  # at most k rows


def search(vectors: DataFrame, notes: DataFrame, query: Column, k: int, threshold: float) -> DataFrame:
    """(rank, path, start_i, end_i, similarity): paths are looked up for the k winners only; a row without a path goes and ranks close up."""
    best = top_k(score(vectors, query), k, threshold)
    found = best.join(notes, "note_id")
    rank = F.row_number().over(W.orderBy("rank"))
    return found.select(rank.cast("int").alias("rank"), "path", "start_i", "end_i", "similarity")


def unique_search(vectors: DataFrame, notes: DataFrame, query: Column, k: int, threshold: float) -> DataFrame:
    """The first row of each path among the top min(k, 1000): the limit comes before the choice, so fewer than k paths may be found."""
    found = search(vectors, notes, query, min(k, UNIQUE_CAP), threshold)
    first = found.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("rank"))).where("place = 1")
    return first.withColumn("rank", F.row_number().over(W.orderBy("rank")).cast("int")).select("rank", "path", "start_i", "end_i", "similarity")


#: Rows of a product at most: of queries, and of vectors; and of queries that are looked through together for a vector.
QUERIES, VECTORS, RUN = 1024, 2048, 64


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(np.square(x, dtype=float).sum(axis=1))


def _single(floor: np.ndarray) -> np.ndarray:
    """The floors in single precision, and no higher."""
    with np.errstate(over="ignore"):
        return np.nextafter(floor.astype(np.float32), np.float32(-np.inf))


def _by_row(product: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of what isn't below the floor of its row; rows are compared only where their greatest isn't."""
    rows = np.flatnonzero(product.max(axis=1) >= floor)
    i, j = np.divmod(np.flatnonzero(product[rows] >= floor[rows, None]), product.shape[1])
    return rows[i], j


def _by_column(product: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of what isn't below the floor of its column; likewise, in runs of rows."""
    whole = len(product) - len(product) % RUN
    runs = product[:whole].reshape(-1, RUN, product.shape[1])
    run, column = np.nonzero(runs.max(axis=1) >= floor)
    hit, row = np.nonzero(runs[run, :, column] >= floor[column, None])
    i, j = np.nonzero(product[whole:] >= floor)
    return np.concatenate([run[hit] * RUN + row, whole + i]), np.concatenate([column[hit], j])


def _exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows of x and rows of y in double precision."""
    step = max(1, 2**21 // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[i[a : a + step]].astype(float), y[j[a : a + step]].astype(float)) for a in range(0, len(i), step)] or [np.zeros(0)])


class _Best:
    """The k best of the vectors seen so far for each query of one dimension; vectors must come in the order of their ids.

    ``floors`` are the k-th best similarities among other vectors (NaN: unknown), below which nothing is held.
    """

    def __init__(self, x: np.ndarray, k: int, threshold: float, floors: np.ndarray | None = None):
        self.x, self.k, self.seen, self.floors = x, k, 0, floors
        self.least = np.full(len(x), float(threshold)) if floors is None else np.fmax(floors - 2 * 10.0**-TIE, threshold)
        self.near, self.sims, self.place = np.full((len(x), k), -np.inf), np.zeros((len(x), k)), np.full((len(x), k), -1)
        self.norm = _lengths(x)

    def add(self, x: np.ndarray, back: _Best | None = None) -> None:
        """All queries meet the vectors; ``back`` are the vectors as queries, which by the same products meet all queries as vectors."""
        at, lengths = 0, _lengths(x) if back is None else back.norm
        while at < len(x):  # few at first, until there is something to beat
            end = min(len(x), at + (VECTORS if self.floors is not None else min(VECTORS, max(256, self.seen))))
            for first in range(0, len(self.x), QUERIES):
                self._product(first, x[at:end], lengths[at:end], back, at)
            self.seen += end - at
            at = end

    def _floor(self, first: int, n: int) -> np.ndarray:
        return np.maximum(self.near[first : first + n, -1] - 10.0**-TIE, self.least[first : first + n])

    def _product(self, first: int, x: np.ndarray, lengths: np.ndarray, back: _Best | None, at: int) -> None:
        """Products in single precision, less what they may be wrong by, leave few pairs; those are computed in double precision."""
        q, norm = self.x[first : first + QUERIES], self.norm[first : first + QUERIES]
        floor, longest = self._floor(first, len(q)), lengths.max()
        if 1e-15 < norm.max() * longest < 1e30 and max(norm.max(), longest) < 1e18:
            part = (q.shape[1] + 8) * 2.0**-24
            product, wrong = q @ x.T, part * norm * longest + 1e-30
            if self.floors is None and not self.seen and len(x) > self.k:
                floor = np.maximum(floor, np.partition(product, -self.k, axis=1)[:, -self.k].astype(float) - wrong - 10.0**-TIE)
            i, j = _by_row(product, _single(floor - wrong))
            self._take(first + i, self.seen + j, _exact(q, i, x, j))
            if back is not None:
                floor, wrong = back._floor(at, len(x)), part * lengths * norm.max() + 1e-30
                i, j = _by_column(product, _single(floor - wrong))
                back._take(at + j, first + i, _exact(q, i, x, j))
        else:
            whole = np.nan_to_num(q.astype(float) @ x.T.astype(float), nan=-np.inf)
            i, j = np.nonzero(whole >= floor[:, None])
            self._take(first + i, self.seen + j, whole[i, j])
            if back is not None:
                i, j = np.nonzero(whole >= back._floor(at, len(x)))
                back._take(at + j, first + i, whole[i, j])

    def _take(self, i: np.ndarray, place: np.ndarray, sims: np.ndarray) -> None:
        """Pairs of queries i and places; a tie with the last that is held is lost, as that one came before."""
        near = np.round(sims, TIE)
        good = (sims > self.least[i]) & (near > self.near[i, -1])
        i, place, sims, near = i[good], place[good], sims[good], near[good]
        if not len(i):
            return
        held, own = np.unique(i, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(held)), self.k), own])
        near = np.concatenate([self.near[held].ravel(), near])
        every = np.concatenate([self.sims[held].ravel(), sims])
        place = np.concatenate([self.place[held].ravel(), place])
        order = np.lexsort((place, -near, owner))
        begins = np.searchsorted(owner[order], np.arange(len(held)))
        best = order[begins[:, None] + np.arange(self.k)]
        self.near[held], self.sims[held], self.place[held] = near[best], every[best], place[best]

    def rows(self, asked: pa.Array, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, vec_id, similarity) of what is held; ``ids`` are those of the places."""
        for at in range(0, len(asked), 8192):
            i, j = np.nonzero(self.place[at : at + 8192] >= 0)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(i + at)), ids.take(pa.array(self.place[i + at, j])), pa.array(self.sims[i + at, j])], names=["query_id", "vec_id", "similarity"])


def _matrices(ids: pa.Array, vecs: pa.Array, floors: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix, floors) of the rows of each dimension, in their order; those without a vector are left out."""
    size = vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]):
        some = pa.array(np.flatnonzero(size == dim))
        x = vecs.take(some).flatten().cast(pa.float32()).fill_null(float("nan"))
        yield int(dim), ids.take(some), x.to_numpy(zero_copy_only=False).reshape(-1, dim), floors.take(some).fill_null(float("nan")).to_numpy(zero_copy_only=False)


#: What a row is in its slot: a query, a vector, or a vector that is a query as well.
ASKING, SEEN, SEEN_AND_ASKING = 0, 1, 2


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, rank, vec_id, similarity) for a table (query_id, vec) of queries.

    All queries meet all vectors.  Both sides are cut into groups, and every pair of groups is a slot of
    one task, which holds the slot's queries and the k best of each, while the vectors go by in the
    order of their ids.  There are two slots to a shuffle partition, of few groups of vectors and many of queries; a
    row travels as often as the other side has groups, and a slot sends on at most k rows for each query.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_held = math.ceil(math.sqrt(parts) / 2)
    n_asked = math.ceil(2 * parts / n_held)
    kinds = queries.schema["query_id"].dataType, vectors.schema["vec_id"].dataType

    def group(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def each(n: int, slot: Callable[[Column], Column]) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), slot)).alias("slot")

    asked = queries.select("query_id", "vec").select(each(n_held, lambda g: g * n_asked + group("query_id", n_asked)), F.lit(ASKING).alias("side"), "query_id", F.lit(None).cast(kinds[1]).alias("vec_id"), "vec")
    held = vectors.select("vec_id", "vec").select(each(n_asked, lambda g: group("vec_id", n_held) * n_asked + g), F.lit(SEEN).alias("side"), F.lit(None).cast(kinds[0]).alias("query_id"), "vec_id", "vec")
    return _ranked(_searched(asked.union(held).withColumn("floor", F.lit(None).cast("double")).repartition(parts, "slot"), k, threshold), k)


def search_all(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """``search_batch`` with all vectors as the queries: every product of two vectors counts for both.

    The vectors are cut into groups.  First each meets its own group; of that, which is written, the k-th
    best is what others must reach.  Then every two groups are a slot, in which both ask.  A slot is a task of its own and of
    the size of any other; either step has two to a shuffle partition at least.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = math.ceil((math.sqrt(16 * parts + 1) + 1) / 2)
    n_asked = math.ceil(n / 2)
    own, some = (F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int") for salt, m in ((0, n), (1, n_asked)))
    row = [F.col("vec_id").alias("query_id"), "vec_id", "vec"]

    seen = vectors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_asked - 1)), lambda g: own * n_asked + g)).alias("slot"), F.lit(SEEN).alias("side"), *row, F.lit(None).cast("double").alias("floor"))
    asked = vectors.select((own * n_asked + some).alias("slot"), F.lit(ASKING).alias("side"), *row, F.lit(None).cast("double").alias("floor"))
    near = written(_ranked(_searched(asked.union(seen).repartitionById(n * n_asked, "slot"), k, threshold), k), "near")

    def met(g: Column) -> Column:
        low, high = F.least("own", g), F.greatest("own", g)
        return F.struct((low * (2 * n - 1 - low) / 2 + high - low - 1).cast("int").alias("slot"), F.when(g < F.col("own"), SEEN_AND_ASKING).otherwise(ASKING).alias("side"))

    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("similarity").alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: g != F.col("own"))
    dealt = vectors.select("vec_id", "vec", own.alias("own")).join(floors, F.col("vec_id") == F.col("of"), "left").select(F.explode(F.transform(others, met)).alias("to"), *row, "floor")
    far = _searched(dealt.select("to.slot", "to.side", "query_id", "vec_id", "vec", "floor").repartitionById(n * (n - 1) // 2, "slot"), k, threshold)
    return _ranked(near.drop("rank").unionByName(far), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("similarity", TIE).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def _searched(dealt: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, vec_id, similarity) of the rows (slot, side, query_id, vec_id, vec, floor), of which those of a slot are in one partition: of each slot the k best at least."""
    kinds = dealt.schema["query_id"].dataType, dealt.schema["vec_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, sides = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            for own, _, best, ids, _ in sides.values():
                if best is not None:
                    yield from best.rows(own[0], pa.concat_arrays(ids))

        for b in batches:
            turns = np.flatnonzero(np.diff(b.column(0).to_numpy() * 3 + b.column(1).to_numpy())) + 1
            for at, end in zip([0, *turns], [*turns, b.num_rows], strict=True):
                if end == at:
                    continue
                part = b.slice(at, end - at)
                side = part.column(1)[0].as_py()
                if part.column(0)[0].as_py() != slot:
                    yield from found()
                    slot, sides = part.column(0)[0].as_py(), {}
                if side == ASKING:
                    for dim, ids, x, floors in _matrices(part.column(2), part.column(4), part.column(5)):
                        own = sides.setdefault(dim, [[], [], None, [], []])
                        own[0].append(ids)
                        own[1].append(x)
                        own[4].append(floors)
                else:
                    for dim, ids, x, floors in _matrices(part.column(3), part.column(4), part.column(5)):
                        if own := sides.get(dim):
                            if own[2] is None:
                                known = np.concatenate(own[4])
                                own[:3] = [pa.concat_arrays(own[0])], None, _Best(np.concatenate(own[1]), k, threshold, None if np.isnan(known).all() else known)
                            back = _Best(x, k, threshold, floors) if side == SEEN_AND_ASKING else None
                            own[2].add(x, back)
                            own[3].append(ids)
                            if back is not None:
                                yield from back.rows(ids, own[0][0])
        yield from found()

    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("vec_id", kinds[1]), T.StructField("similarity", T.DoubleType())])
    return dealt.sortWithinPartitions("slot", "side", "vec_id").mapInArrow(run, schema) if k > 0 else dealt.sparkSession.createDataFrame([], schema)
