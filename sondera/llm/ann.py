"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors lie in cells round sampled centroids.  In its cell a vector's residual, made a unit vector
and turned by one random rotation, is coded by its signs: one bit a dimension, packed.  With the
correction <signs, residual> / sqrt(d) kept as a scalar, the packed bits give an unbiased estimate of
the inner product with a query's rotated residual, and an error bound that a chosen share of pairs
keep.  The index has every vector's code and scalars, made once, in one table with the vectors by cell;
a search reads the codes of the cells that it probes, and compares exactly only those vectors whose bound
reaches the k-th best exact similarity known so far.  That comes from a first search of a query's
nearest cells, of which the best by estimate are compared.

How many cells a query probes is measured, not guessed: for a sample of queries the exact
neighbours among all vectors are found, and the least number of cells that holds the wanted share
of them (with a margin) is taken.  The sample that places the centroids grows with the cells.  The
queries measured are none of it, as a vector draws its own centroid near and so seems to need fewer
cells than others; only where the sample is the whole table are they taken from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_sample, rows_of, written

#: Queries are the rows whose id is divisible by EVERY.  EPSILON is in standard deviations of the estimate.
K, EVERY, EPSILON, COVERAGE = 10, 100, 3.0, 0.97
#: The first search of a query goes through its nearest cell, and of the others it probes one in FIRST; of each the best FEW * k by estimate are compared.
FIRST, FEW = 16, 2
#: Sizes of the samples: vectors for the centroids, as long as that is PER_CELL for each cell, else PER_CELL for each; queries for the number of cells.
MOST_TRAINED, MOST_MEASURED, PER_CELL = 20_000, 1024, 30


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Cells from the nearest on, by Euclidean distance."""
        d = (self.centroids**2).sum(axis=1)[None, :] - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell."""
        return _home(x, self.centroids)

    def code(self, x: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs of the rotated residuals, and three scalars for each.

        They are the factor that makes of <signs, turned query> an estimate, the deviation of its error for a
        query at distance 1 from the centroid c, and <c, x - c>.
        """
        c = self.centroids[cell]
        r = x - c
        norm = np.linalg.norm(r, axis=1)
        turned = np.divide(r, norm[:, None], out=np.zeros_like(r), where=norm[:, None] > 0) @ self.rotation
        match = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.dim), 1e-6)
        error = np.sqrt(np.maximum(1 - match**2, 0)) / match * norm / np.sqrt(max(self.dim - 1, 1))
        return np.packbits(turned >= 0, axis=1), np.stack([norm / (np.sqrt(self.dim) * match), error, r @ c], axis=1).astype(np.float32)

    def ahead(self, queries: np.ndarray, cell: int, epsilon: float) -> np.ndarray:
        """Queries so laid out that their products with ``behind`` are estimates plus ``epsilon`` deviations."""
        c = self.centroids[cell]
        q = queries - c
        return np.column_stack([q @ self.rotation, epsilon * np.linalg.norm(q, axis=1), np.ones(len(q)), queries @ c]).astype(np.float32)

    def behind(self, packed: np.ndarray, scalars: np.ndarray) -> np.ndarray:
        """<q, x> = <q, c> + <c, x - c> + <q - c, x - c>, of which the last is estimated."""
        out = np.empty((len(packed), self.dim + 3), np.float32)
        np.multiply(np.unpackbits(packed, axis=1, count=self.dim), 2 * scalars[:, :1], out=out[:, : self.dim])
        out[:, : self.dim] -= scalars[:, :1]
        out[:, self.dim : self.dim + 2] = scalars[:, 1:]
        out[:, -1] = 1
        return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and those rows: ``dim`` finite numbers, not all 0."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return unit(x[good]), rows[good]


def _home(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the centroids ``c``; a few million products at once."""
    half, step = 0.5 * (c**2).sum(axis=1), max(1, (1 << 22) // len(c))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(x[at : at + step] @ c.T - half, axis=1) for at in range(0, len(x), step))])


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = _home(sample, c)
        order = np.argsort(own, kind="stable")
        used, first, size = np.unique(own[order], return_index=True, return_counts=True)
        for k, at, n in zip(used, first, size, strict=True):
            c[k] = sample[order[at : at + n]].mean(axis=0)
    return c


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then by lesser id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _nearest_of_sample(queries: np.ndarray, query_ids: np.ndarray, dim: int, k: int):
    """Exact neighbours of some queries in each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim)))
        held = [none] * len(queries)
        floors = np.full(len(queries), -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x, rows = _matrix(b.column(1), dim)
                if not len(x):
                    continue
                ids = b.column(0).to_numpy()[rows]
                sims = queries @ x.T
                for q in np.flatnonzero(sims.max(axis=1) >= floors):
                    some = np.flatnonzero((sims[q] >= floors[q]) & (ids != query_ids[q]))
                    some = some[_top(ids[some], sims[q, some], k)]
                    all_ids, all_sims, all_x = (np.concatenate(c) for c in zip(held[q], (ids[some], sims[q, some], x[some]), strict=True))
                    best = _top(all_ids, all_sims, k)
                    held[q] = (all_ids[best], all_sims[best], all_x[best])
                    if len(best) == k:
                        floors[q] = all_sims[best[-1]]
        out = [(q, int(i), float(s), v.tobytes()) for q, mine in enumerate(held) for i, s, v in zip(*mine, strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.binary()), strict=True)], names=["q", "id", "sim", "x"])

    return run


def _drawn(vectors: DataFrame, n: int, most: int) -> DataFrame:
    """``bounded_sample``, of those rows only whose hash is small enough to be in it: else every partition would sort and send as many."""
    if n > 2 * most:
        vectors = vectors.where(F.xxhash64("id") < F.lit(int(2**64 * (2 * most / n)) - 2**63))
    return bounded_sample(vectors, "id", most)


def build(vectors: DataFrame, k: int = K, coverage: float = COVERAGE, most_trained: int = MOST_TRAINED, most_measured: int = MOST_MEASURED) -> Index | None:
    """The index of (id, vec); its cells grow with the square root of the vectors, and with them the sample that places them.  None without vectors."""
    n = vectors.count()
    dim = vectors.agg(F.mode(F.size("vec"))).first()[0]
    if not n or not dim or dim < 1:
        return None
    cells = max(1, int(np.sqrt(n) / 2))
    trained = max(most_trained, PER_CELL * cells)
    drawn = _drawn(vectors, n, trained + most_measured).toArrow().combine_chunks()
    sample, rows = _matrix(drawn.column("vec").combine_chunks(), dim)
    if not len(sample):
        return None
    ids = drawn.column("id").to_numpy()[rows]
    measured, measured_ids = sample[:most_measured], ids[:most_measured]
    if drawn.num_rows < n and len(sample) > most_measured:  # else all are trained on, and those measured are like all others
        sample = sample[most_measured:]
    cells = min(cells, len(sample))
    index = Index(centroids(sample, cells), np.linalg.qr(np.random.default_rng(5).normal(size=(dim, dim)))[0], cells)
    found = vectors.mapInArrow(_nearest_of_sample(measured, measured_ids, dim, k), "q int, id long, sim double, x binary")
    best = found.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("place") <= k).toArrow()
    if best.num_rows:
        x = np.array([np.frombuffer(v, np.float64) for v in best.column("x").to_pylist()])
        home = index.home(x)
        order = index.ranked(measured)
        place = np.argsort(order, axis=1)[best.column("q").to_numpy(), home]
        index.probes = int(np.sort(place)[min(len(place) - 1, int(np.ceil(coverage * len(place))))]) + 1
    return index


#: Blocks of up to some thousand vectors of one cell.  ``block`` is the first id, which no other block has; scalars and vecs are of single precision.
BLOCKS = "cell int, block long, n int, ids binary, codes binary, scalars binary, vecs binary"
#: Blocks of queries for a group of cells; ``probes`` has the cells of the group that each probes, as packed bits.
ASKED = "part int, ids binary, vecs binary, floors binary, probes binary"
#: Pairs to be compared: the queries, and for each pair the places of the query among them and of the vector in its block.
PAIRS = "block long, ids binary, vecs binary, floors binary, query binary, place binary"


def _batch(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[t]) for (_, t), v in zip(fields, values, strict=True)], names=[n for n, _ in fields])


def _of(b: pa.RecordBatch, column: int, row: int, kind, width: int = 0) -> np.ndarray:
    flat = np.frombuffer(b.column(column)[row].as_py(), kind)
    return flat.reshape(-1, width) if width else flat


def _block(cell: int, parts: list[tuple]) -> pa.RecordBatch:
    ids, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    return _batch(BLOCKS, [cell, int(ids[0]), len(ids), ids, *rest])


def _assign(index: Index, block: int):
    """Blocks of the rows (id, vec) in their nearest cells, coded, as far as one partition has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, min(block, 4096)):
                b = whole.slice(at, min(block, 4096))
                x, rows = _matrix(b.column(1), index.dim)
                cells = index.home(x)
                ids = b.column(0).to_numpy()[rows]
                for k in np.unique(cells):
                    own = np.flatnonzero(cells == k)
                    mine = held.setdefault(int(k), [])
                    if sum(len(m[0]) for m in mine) + len(own) > block:
                        yield _block(int(k), mine)
                        mine.clear()
                    mine.append((ids[own], *index.code(x[own], k), x[own].astype(np.float32)))
        for k, mine in held.items():
            if mine:
                yield _block(k, mine)

    return run


def _gather(dim: int, block: int):
    """Makes of a cell's blocks, from all partitions, as few as can be."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for row in range(b.num_rows):
                k, n = b.column(0)[row].as_py(), b.column(2)[row].as_py()
                mine = held.setdefault(k, [])
                if mine and sum(len(m[0]) for m in mine) + n > block:
                    yield _block(k, mine)
                    mine.clear()
                mine.append((_of(b, 3, row, np.int64), _of(b, 4, row, np.uint8, -(-dim // 8)), _of(b, 5, row, np.float32, 3), _of(b, 6, row, np.float32, dim)))
        for k, mine in held.items():
            if mine:
                yield _block(k, mine)

    return run


def groups(n: int, cells: int) -> int:
    """Cell c is in group c % groups.  A query travels once to each group in which it probes a cell, not once to each cell."""
    return max(1, min(cells, max(16, int(n) // 8192)))


def _ask(index: Index, parts: int, most: int, block: int):
    """Blocks of the queries (id, vec, floor) for each group of cells, with the cells among their ``most`` nearest that are in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        cells = len(index.centroids)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x, rows = _matrix(b.column(1), index.dim)
                wanted = np.zeros((len(x), -(-cells // parts) * parts), bool)
                np.put_along_axis(wanted, index.ranked(x)[:, :most], True, axis=1)
                ids, floors, x = b.column(0).to_numpy()[rows], b.column(2).to_numpy()[rows], x.astype(np.float32)
                for part in range(parts):
                    mine = wanted[:, part::parts]
                    own = np.flatnonzero(mine.any(axis=1))
                    if len(own):
                        kept = held.setdefault(part, [])
                        kept.append((ids[own], x[own], floors[own], np.packbits(mine[own], axis=1)))
                        if sum(len(m[0]) for m in kept) >= block:
                            yield _batch(ASKED, [part, *map(np.concatenate, zip(*held.pop(part), strict=True))])
        for part, kept in held.items():
            yield _batch(ASKED, [part, *map(np.concatenate, zip(*kept, strict=True))])

    return run


def candidates(index: Index, cell: int, q: np.ndarray, floors: np.ndarray, packed: np.ndarray, scalars: np.ndarray, k: int | None, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a vector of the cell, from codes alone: those whose bound reaches the query's floor, or with ``k`` the best FEW * k by estimate."""
    behind = index.behind(packed, scalars).T
    rows, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    step = max(1, (1 << 20) // max(len(packed), 1))
    for at in range(0, len(q), step):
        ahead = index.ahead(q[at : at + step], cell, epsilon if k is None else 0.0)
        if k is None:
            ahead[:, -1] -= (floors[at : at + step] - 1e-5).astype(np.float32)  # then those not below 0 reach it
            row, place = np.nonzero(ahead @ behind >= 0)
        else:
            few = min(FEW * k, len(packed))
            place = np.argpartition(-(ahead @ behind), few - 1, axis=1)[:, :few].ravel()
            row = np.repeat(np.arange(len(ahead)), few)
        rows.append((at + row).astype(np.int32))
        places.append(place.astype(np.int32))
    return np.concatenate(rows), np.concatenate(places)


def _scan(index: Index, parts: int, k: int | None, epsilon: float):
    """Of a block of queries and a block of codes: the pairs to be compared, with the queries that they need."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                cell, block = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                ids = _of(b, 4, row, np.int64)
                bits = _of(b, 7, row, np.uint8).reshape(len(ids), -1)
                here = cell // parts
                own = np.flatnonzero((bits[:, here >> 3] >> (7 - (here & 7))) & 1)
                if len(own):
                    q, floors = _of(b, 5, row, np.float32, index.dim)[own], _of(b, 6, row, np.float64)[own]
                    query, place = candidates(index, cell, q, floors, _of(b, 2, row, np.uint8, -(-index.dim // 8)), _of(b, 3, row, np.float32, 3), k, epsilon)
                    if len(query):
                        used, query = np.unique(query, return_inverse=True)
                        yield _batch(PAIRS, [block, ids[own][used], q[used], floors[used], query.astype(np.int32), place])

    return run


def compared(q: np.ndarray, x: np.ndarray, floors: np.ndarray, query: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs in order of their queries those that reach the query's floor, with their similarities in double precision."""
    rough = np.empty(len(query), np.float32)
    ends = np.append(np.flatnonzero(np.diff(query)) + 1, len(query)) if len(query) else np.zeros(0, np.int64)
    begin = 0
    for end in ends.tolist():  # one product for each query
        np.dot(x[place[begin:end]], q[query[begin]], out=rough[begin:end])
        begin = end
    near = np.flatnonzero(rough >= (floors[query] - 1e-5).astype(np.float32))
    query, place = query[near], place[near]
    exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[query[at : at + 65536]], x[place[at : at + 65536]], dtype=np.float64) for at in range(0, len(query), 65536))])
    good = exact >= floors[query] - 1e-6
    return query[good], place[good], exact[good]


def _compare(dim: int, k: int):
    """Exact similarities of pairs, those that reach their query's floor; of one block the k best for each query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q_ids, q, floors = _of(b, 0, row, np.int64), _of(b, 1, row, np.float32, dim), _of(b, 2, row, np.float64)
                ids, x = _of(b, 5, row, np.int64), _of(b, 6, row, np.float32, dim)
                query, place, exact = compared(q, x, floors, _of(b, 3, row, np.int32), _of(b, 4, row, np.int32))
                other = q_ids[query] != ids[place]
                query, place, exact = query[other], place[other], exact[other]
                order = np.lexsort((ids[place], -exact, query))
                query, place, exact = query[order], place[order], exact[order]
                best = np.arange(len(query)) - np.searchsorted(query, query) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query[best]]), pa.array(ids[place[best]]), pa.array(exact[best])], names=["id", "neighbour", "similarity"])

    return run


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY, coverage: float = COVERAGE, epsilon: float = EPSILON, block: int = 4096, slice_of: int = 1 << 16) -> DataFrame:
    """(vec_id, neighbour, rank, similarity): for every row whose id is divisible by ``every`` its ``k`` nearest other rows by cosine.

    All rows are searched, and with ``every`` 1 all are queries.  Ties go to the lesser id.  Rows with a null
    id, or whose vector is null, zero, not finite or of another length than most, are neither queries nor
    neighbours.  Rows that repeat an id are one if their vectors are equal (else the greatest vector counts).
    Ids must be integers; other columns, whatever their names, aren't read; an empty table, or one without
    such an id, gives an empty result.  Codes of a group of cells with over ``slice_of`` vectors, such as one
    with a cell of copies, are spread over several tasks.
    """
    vectors = rows_of(df, id_col, vec=vec_col).select("id", F.col("vec").cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    vectors = written(vectors.groupBy("id").agg(F.max("vec").alias("vec")), "vectors")
    index = build(vectors, k, coverage)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, neighbour long, rank int, similarity double")
    # full blocks needn't come together with others of their cell, which may be a hot one
    loose = F.when(F.col("n") * 2 > block, F.xxhash64("block")).otherwise(F.lit(0))
    data = written(vectors.mapInArrow(_assign(index, block), BLOCKS).repartition("cell", loose).mapInArrow(_gather(index.dim, block), BLOCKS), "cells")
    n, dim, cells = data.agg(F.sum("n")).first()[0] or 0, index.dim, len(index.centroids)
    parts = groups(n, cells)
    codes = data.select("cell", "block", "n", "codes", "scalars", (F.col("cell") % parts).cast("int").alias("part"))
    slices = codes.groupBy("part").agg(F.ceil(F.sum("n") / slice_of).cast("int").alias("slices"))
    codes = codes.join(slices, "part").withColumn("slice", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int")).select("part", "slice", "cell", "block", "codes", "scalars")
    queries = vectors.where(F.col("id") % every == 0)
    in_order = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")

    def searched(asking: DataFrame, most: int, by_estimate: int | None) -> DataFrame:
        asked = asking.mapInArrow(_ask(index, parts, most, block), ASKED).join(slices, "part").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
        met = asked.join(codes, ["part", "slice"]).select("cell", "block", "codes", "scalars", "ids", "vecs", "floors", "probes")
        pairs = met.mapInArrow(_scan(index, parts, by_estimate, epsilon), PAIRS)
        held = data.select("block", F.col("ids").alias("x_ids"), F.col("vecs").alias("x_vecs"))
        pairs = pairs.join(held, "block").select("ids", "vecs", "floors", "query", "place", "x_ids", "x_vecs")
        return pairs.mapInArrow(_compare(dim, k), "id long, neighbour long, similarity double")

    none = F.lit(float("-inf"))
    first = searched(queries.withColumn("floor", none), 1 + (index.probes - 1) // FIRST, k)
    first = written(first.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k), "first")
    floors = first.where(F.col("rank") == k).select("id", F.col("similarity").alias("floor"))
    asking = queries.join(floors, "id", "left").select("id", "vec", F.coalesce("floor", none).alias("floor"))
    found = searched(asking, index.probes, None).unionAll(first.drop("rank")).groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return best.select(F.col("id").alias("vec_id"), "neighbour", "rank", F.round("similarity", 6).alias("similarity"))
