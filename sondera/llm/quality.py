"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing gives each word a fixed sparse vector of +1 and -1; a word's context vector is the
sum of the sparse vectors of its neighbours over the whole corpus.  Words are hashed to ``BUCKETS``,
so the table of context vectors has one fixed size whatever the corpus; every partition makes its
own and they are added up block by block.  A document is the weighted mean and spread of its
words' vectors, rare words counting more; a network with one hidden layer reads that, and
its probabilities are calibrated with one temperature on documents kept out of its training.
Words keep their case, and runs of punctuation are words of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, picked, rows_of
from .textvec import RUNS, mix, token_hashes

BITS, DIM, NONZERO, REACH, ROWS = 14, 64, 4, 2, 256
BUCKETS = 1 << BITS
#: Bound of the labelled sample on which the network is trained and calibrated.
MOST_LABELLED = 6000
_STEP = 1 << 15


def index_vectors() -> np.ndarray:
    """Every bucket's sparse vector, and a row of zeros for no neighbour."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0xABCDEF))
    out = np.zeros((BUCKETS + 1, DIM), np.int8)
    np.add.at(out, (np.repeat(np.arange(BUCKETS), NONZERO), (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.int8))
    return out


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def context_counts(column: pa.Array, table: np.ndarray, counts: np.ndarray, index: np.ndarray) -> None:
    """Adds to each word's row of ``table`` its neighbours' sparse vectors, to ``counts`` its occurrences."""
    for _, _, hashes, offsets, _ in token_hashes(column, RUNS, fold=False):
        words = _buckets(hashes)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        around = np.zeros((len(words), DIM), np.int8)
        for d in range(1, REACH + 1):
            same = owner[d:] == owner[:-d]
            around[:-d] += index[np.where(same, words[d:], BUCKETS)]
            around[d:] += index[np.where(same, words[:-d], BUCKETS)]
        order = np.argsort(words.astype(np.uint16), kind="stable")  # by radix
        kinds, first, n = np.unique(words[order], return_index=True, return_counts=True)
        counts[kinds] += n
        for at in range(0, len(kinds), 4096):  # bounds the reordered copy
            a, b = first[at], first[at + 4096] if at + 4096 < len(kinds) else len(words)
            table[kinds[at : at + 4096]] += np.add.reduceat(around[order[a:b]], first[at : at + 4096] - a, axis=0, dtype=np.int32)


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts, any_row = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64), False
    index = index_vectors()
    for b in batches:
        any_row = any_row or b.num_rows > 0
        context_counts(b.column(0), table, counts, index)
    if any_row:
        parts = [np.concatenate([counts[k : k + ROWS, None], table[k : k + ROWS]], axis=1).astype("<i4" if np.abs(table).max() < 1 << 30 else "<i8") for k in range(0, BUCKETS, ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.itemsize for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "width", "data"])


def _total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, width, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            block = np.frombuffer(data.as_py(), f"<i{width}").astype(np.int64)
            sums[part] = sums[part] + block if part in sums else block
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([8] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "width", "data"])


@dataclass
class WordVectors:
    vectors: np.ndarray  # BUCKETS x DIM float32
    weights: np.ndarray  # BUCKETS float32

    def pool(self, column: pa.Array) -> np.ndarray:
        """Mean and spread of the vectors of each text's words: one row of 2 * DIM; zeros for a text without words."""
        n = len(column)
        first, second, mass = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros(n)
        for lo, hi, hashes, offsets, _ in token_hashes(column, RUNS, fold=False):
            words = _buckets(hashes)
            for at in range(0, len(words), _STEP):
                own = words[at : at + _STEP]
                a, b = np.searchsorted(offsets, at, "right") - 1, int(np.searchsorted(offsets, at + len(own), "left"))
                cuts = np.clip(offsets[a:b] - at, 0, len(own))
                rows = np.flatnonzero(np.diff(np.append(cuts, len(own))))  # reduceat gives no empty sums
                cuts, rows = cuts[rows], rows + a + lo
                weight = self.weights[own]
                v = self.vectors[own] * weight[:, None]
                np.add.at(first, rows, np.add.reduceat(v, cuts))
                v *= self.vectors[own]
                np.add.at(second, rows, np.add.reduceat(v, cuts))
                np.add.at(mass, rows, np.add.reduceat(weight, cuts))
        safe = np.maximum(mass, 1e-9)[:, None]
        mean = first / safe
        return np.concatenate([mean, np.sqrt(np.maximum(second / safe - mean * mean, 0))], axis=1).astype(np.float32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> WordVectors:
    """Random-indexing vectors from all texts; a null text has no words."""
    text = picked(docs, text=text_col).where("text is not null")
    schema = "part int, width int, data binary"
    summed = text.mapInArrow(_partial, schema).repartition("part").mapInArrow(_total, schema)
    table = np.zeros((BUCKETS, DIM + 1), np.int64)
    for part, data in _parts(summed):
        table[part * ROWS : (part + 1) * ROWS] = np.frombuffer(data, "<i8").reshape(ROWS, DIM + 1)
    counts, vectors = table[:, 0].astype(float), table[:, 1:].astype(np.float64)
    total = counts.sum()
    if total:
        mean = vectors.sum(axis=0) / max(counts.sum(), 1)
        vectors = vectors - counts[:, None] * mean  # what every word's neighbours have in common
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    return WordVectors(vectors.astype(np.float32), (1e-3 / (1e-3 + counts / max(total, 1))).astype(np.float32))


def _parts(summed: DataFrame) -> list[tuple[int, bytes]]:
    """Exactly BUCKETS / ROWS rows at most, of a fixed size."""
    found = summed.select("part", "data").toArrow()
    return list(zip(found.column("part").to_pylist(), found.column("data").to_pylist(), strict=True))


@dataclass
class Network:
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Trains on four fifths of the rows and takes the temperature from the rest.  Of one class alone, its share is the answer."""
    n = len(y)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if n < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    order = rng.permutation(n)
    held, own = order[: n // 5], order[n // 5 :]
    centre, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - centre) / spread
    for _ in range(epochs):
        shuffled = rng.permutation(own)
        for at in range(0, len(own), 64):
            rows = shuffled[at : at + 64]
            a = z[rows]
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - y[rows]) / len(rows)
            dh = e[:, None] * p[2] * (1 - h * h)
            grads = [a.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, spread, p[0], p[1], p[2], float(p[3][0]))
    logits = net.logit(x[held])

    def loss(t: float) -> float:
        s = np.clip(logits / t, -40, 40)
        return float(np.mean(np.logaddexp(0, s) - y[held] * s))

    net.temperature = float(min(np.geomspace(0.25, 16, 121), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, words: WordVectors, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> Network:
    """The network from a sample of ``most_labelled`` labelled documents, by hash of the id; a null id or label isn't used."""
    marked = rows_of(labels, id_col, y=label_col).withColumn("y", F.col("y").cast("int")).where("id is not null and y is not null")
    chosen = bounded_sample(marked.groupBy("id").agg(F.max("y").alias("y")), "id", most_labelled)
    rows = rows_of(docs, id_col, text=text_col).where("id is not null and text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pooled = words.pool(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in pooled], pa.binary())], names=["id", "y", "x"])

    own = rows.join(F.broadcast(chosen), "id").select("id", "y", "text")  # at most most_labelled ids
    found = own.mapInArrow(run, "id long, y int, x binary").orderBy("id", "x").toArrow()
    x = np.array([np.frombuffer(b, np.float32) for b in found.column("x").to_pylist()], np.float64).reshape(-1, 2 * DIM)
    return fit(x, found.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """(doc_id, quality, is_good) for every row: the calibrated probability of good quality.

    Whole texts are read, however long.  A null text is read as an empty one, which has the pooled vector
    0; rows that are repeated are scored alike; a null id stays null; an empty table gives an empty result;
    where labels are of one kind or fewer than ten, all texts get their share.  Ids must be integers; other
    columns, whatever their names, aren't read.
    """
    words = word_vectors(docs, text_col)
    net = train(docs, labels, words, id_col, text_col, **training)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(net.probability(words.pool(part.column(1))), 6))], names=["doc_id", "quality"])

    out = rows_of(docs, id_col, text=text_col).mapInArrow(run, "doc_id long, quality double")
    return out.select("doc_id", "quality", (F.col("quality") >= threshold).alias("is_good"))
