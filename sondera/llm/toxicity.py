"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a sample of all documents the unlabelled; the risk is
``pi R_P(+) + max(0, R_U(-) - pi R_P(-))`` with the sigmoid loss, where ``pi`` is the share of toxic
documents: that among the labelled ones if both kinds are labelled, else an estimate from the two
samples (``estimated_prior``).  Features are words and their beginnings of four and five bytes, so that
inflected forms count.  Those that aren't surely more frequent in the positives than in what the
unlabelled have beside positives are screened out; evidence only ever adds to the score, and a text
without any isn't toxic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, by_place, place, rows_of
from .textvec import token_hashes

#: Bounds of the training samples: confirmed toxic documents, unlabelled documents.
MOST_POSITIVE, MOST_UNLABELLED = 2000, 8000
PREFIXES = (4, 5)


@dataclass
class Model:
    features: np.ndarray  # sorted uint32
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities of toxicity; a text without any feature, such as a null or empty one, has 0."""
        out = np.full(len(column), -np.inf)
        if len(self.features):
            may = np.zeros(1 << 20, bool)
            may[self.features >> np.uint32(12)] = True
            for lo, _, whole, offsets, heads in token_hashes(column, prefixes=PREFIXES):
                row, found = [], []
                for h in (whole, *heads):
                    at = np.flatnonzero(may[(h >> np.uint64(44)).astype(np.int64)])
                    value = (h[at] >> np.uint64(32)).astype(np.uint32)
                    place = np.minimum(np.searchsorted(self.features, value), len(self.features) - 1)
                    hit = self.features[place] == value
                    row.append(np.searchsorted(offsets, at[hit], "right") - 1)
                    found.append(place[hit])
                both = np.unique(np.concatenate(row) * len(self.features) + np.concatenate(found))
                of = lo + both // len(self.features)
                out[of] = self.bias
                np.add.at(out, of, self.weights[both % len(self.features)])
        return np.where(np.isfinite(out), 1 / (1 + np.exp(-np.clip(out, -40, 40))), 0.0)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = []
        for lo, hi, whole, offsets, heads in token_hashes(b.column(1), prefixes=PREFIXES):
            for k in range(hi - lo):
                own = [(h[offsets[k] : offsets[k + 1]] >> np.uint64(32)).astype(np.uint32) for h in (whole, *heads)]
                packed.append(np.unique(np.concatenate(own)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["positive", "features"])


def surely(count: np.ndarray, n: int) -> np.ndarray:
    """The share ``count`` of ``n`` less two of its standard deviations."""
    p = count / n
    return p - 2 * np.sqrt(p * (1 - p) / n)


def telling(count_p: np.ndarray, n_p: int, count_u: np.ndarray, n_u: int, prior: float) -> np.ndarray:
    """Features that two positives have and whose share among positives is surely over twice that among the unlabelled that aren't positive, ``(u - prior * p) / (1 - prior)``."""
    low, u = surely(count_p, n_p), count_u / n_u
    return (count_p >= 2) & (low > u) & (low > 2 * np.maximum(u - prior * count_p / n_p, 0) / (1 - prior))


def _counted(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the positives, and how many positives and unlabelled have each."""
    ids, count_p = np.unique(np.concatenate(positive), return_counts=True)
    ids_u, count = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(ids_u, ids), max(len(ids_u) - 1, 0))
    return ids, count_p, np.where(ids_u[at] == ids, count[at], 0) if len(ids_u) else np.zeros(len(ids), np.int64)


def _rows(docs: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """Places in ``ids`` of each document's features."""
    out = []
    for d in docs:
        p = np.minimum(np.searchsorted(ids, d), len(ids) - 1)
        out.append(p[ids[p] == d])
    return out


def estimated_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """The share of positives among the unlabelled from the two samples alone; 0 if they can't be told apart.

    As the unlabelled are positives and others, no set of texts can have a smaller share of the unlabelled
    than ``pi`` times its share of the positives: ``pi`` is at most the least quotient of the two.  The sets are
    those above a score, a sum of log odds from one half of either sample, measured on the other half;
    they must hold a fifth of the positives, and both halves take turns.  A share of the positives counts less one
    deviation, as the least of many quotients is of one that came out low.  Features are screened as in ``fit``
    with a prior of 0: where over a quarter of the unlabelled are positive fewer are frequent enough, the estimate
    comes out low, and ``prior`` had better be given.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.0
    counted = [_counted(positive[half::2], unlabelled[half::2]) for half in (0, 1)]
    if not all(len(ids) for ids, _, _ in counted):
        return 0.0
    others = [(_rows(positive[1 - half :: 2], counted[half][0]), _rows(unlabelled[1 - half :: 2], counted[half][0])) for half in (0, 1)]
    score_p, score_u = [], []
    for half, (_, count_p, count_u) in enumerate(counted):
        n_p, n_u = len(positive[half::2]), len(unlabelled[half::2])
        odds = np.log((count_p + 0.5) / (n_p + 1)) - np.log((count_u + 0.5) / (n_u + 1))
        odds = np.where(telling(count_p, n_p, count_u, n_u, 0.0), odds, 0)
        score_p += [odds[d].sum() for d in others[half][0]]
        score_u += [odds[d].sum() for d in others[half][1]]
    p, u = np.sort(score_p), np.sort(score_u)
    cuts = np.unique(p[: int(0.8 * len(p)) + 1])
    cuts = cuts[cuts > 0]
    if not len(cuts):
        return 0.0
    share_p, share_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    least = np.maximum(share_p - np.sqrt(share_p * (1 - share_p) / len(p)), 0.5 / len(p))
    return float(np.clip((share_u / least).min(), 0.0, 0.95))


def gradient(w: np.ndarray, b: float, xp: list[np.ndarray], xu: list[np.ndarray], prior: float) -> tuple[np.ndarray, float, float, float]:
    """Of the risk of a batch by the weights and the bias, then its positive and its negative part.

    Where the negative part is below zero, it is that of its reflection: the step goes back up.
    """

    def forward(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        return 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(docs)) + b, -40, 40))), flat, owner

    (sp, fp, op), (su, fu, ou) = forward(xp), forward(xu)
    dp, du = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
    negative = su.mean() - prior * sp.mean()
    gp, gu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
    return np.bincount(fp, gp[op], len(w)) + np.bincount(fu, gu[ou], len(w)), gp.sum() + gu.sum(), prior * (1 - sp).mean(), negative


NOTHING = Model(np.zeros(0, np.uint32), np.zeros(0), -10.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Trains on arrays of feature ids, of which the ``telling`` ones are kept.  Without positives, or with a prior of 0, nothing is toxic."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return NOTHING
    ids, count_p, count_u = _counted(positive, unlabelled)
    ids = ids[telling(count_p, len(positive), count_u, len(unlabelled), prior)]
    n = len(ids)
    if n == 0:
        return NOTHING
    pos, unl = _rows(positive, ids), _rows(unlabelled, ids)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n), -1.0
    m, v, step = np.zeros(n + 1), np.zeros(n + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for k in range(0, len(order), 500):
            gw, gb, _, _ = gradient(w, b, [pos[i] for i in rng.permutation(len(pos))[:250]], [unl[i] for i in order[k : k + 500]], prior)
            g = np.append(gw + decay * w, gb)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return Model(ids, w, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fits the model to bounded samples by hash of the id: ``most_positive`` confirmed toxic documents, ``most_unlabelled`` of all.

    ``prior`` is the share of toxic documents; by default that of the labels if they are of both kinds, else
    ``estimated_prior``.  Documents and labels with a null id aren't trained on; a document labelled more
    than once counts once, as toxic if one label says so; a null label says nothing.  Ids must be integers.
    """
    marked = rows_of(labels, id_col, y=label_col).withColumn("y", F.col("y").cast("int")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    if prior is None:
        low, high, mean = marked.agg(F.min("y"), F.max("y"), F.avg("y")).first()
        prior = float(mean) if low != high else None if high == 1 else 0.0
    rows = rows_of(docs, id_col, text=text_col).where("id is not null and text is not null")
    confirmed = bounded_sample(marked.where("y = 1").select("id"), "id", most_positive)
    drawn = bounded_sample(rows.select("id"), "id", most_unlabelled).distinct()
    wanted = confirmed.select("id", F.lit(1).alias("positive")).unionAll(drawn.select("id", F.lit(0).alias("positive")))
    picked = rows.join(F.broadcast(wanted), "id").select("positive", "text")  # at most most_positive + most_unlabelled ids
    found = picked.mapInArrow(_features, "positive int, features binary").toArrow()
    side = found.column("positive").to_numpy()
    lists = [np.frombuffer(x, np.uint32) for x in found.column("features").to_pylist()]
    order = sorted(range(len(lists)), key=lambda k: (side[k], lists[k].tobytes()))  # whatever the order of arrival
    positive, unlabelled = [lists[k] for k in order if side[k]], [lists[k] for k in order if not side[k]]
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled) if prior is None else prior)


def probability(model: Model, text):
    """A column of probabilities of toxicity."""

    @F.arrow_udf("double")
    def toxicity(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column))

    return toxicity(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """(doc_id, toxicity, is_toxic) for every row of ``docs``, each judged by itself on its whole text.

    A null or empty text, or one without any feature, has toxicity 0; rows that are repeated are scored
    alike and all returned; a null id stays null; an empty table gives an empty result; without a
    confirmed toxic document nothing is toxic.  Other columns, whatever their names, aren't read.
    """
    model = train(docs, labels, id_col, text_col, **training)
    scored = rows_of(docs, id_col, text=text_col).select(F.col("id").alias("doc_id"), probability(model, F.col("text")).alias("toxicity"))
    return scored.select("doc_id", F.round("toxicity", 6).alias("toxicity"), (F.col("toxicity") > threshold).alias("is_toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """The rows that aren't toxic by ``score_toxicity``, with all their columns, whatever their names.

    A row with a null id or a null or empty text is judged like any other (and so the latter stay); of
    rows that are repeated all stay or all go; an empty table stays empty.
    """
    model = train(docs, labels, id_col, text_col, **training)
    return by_place(docs).where(probability(model, F.col(f"c{place(docs, text_col)}")) <= threshold).toDF(*docs.columns)
