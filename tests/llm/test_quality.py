import random

import numpy as np
import pyarrow as pa
import pytest

from sondera.llm import quality as ql
from sondera.llm.textvec import RUNS, token_hashes

GOOD, BAD = [f"good{k}" for k in range(150)], [f"junk{k}" for k in range(60)]
BOTH = [f"both{k}" for k in range(150)]


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        good = rng.random() < 0.6
        rows.append((k, " ".join(rng.choice(GOOD if good else BAD) if rng.random() < 0.4 else rng.choice(BOTH) for _ in range(rng.randrange(15, 100))), "x", int(good)))
    return rows


def test_context_vectors_against_brute_force():
    texts = ["a b c a", "", "b a", "lone", "x, y!! z"]
    table, counts = np.zeros((ql.BUCKETS, ql.DIM), np.int64), np.zeros(ql.BUCKETS, np.int64)
    index = ql.index_vectors()
    ql.context_counts(pa.array(texts), table, counts, index)
    want, n = np.zeros_like(table), np.zeros_like(counts)
    for t in texts:
        for _, _, hashes, _, _ in token_hashes(pa.array([t]), RUNS, fold=False):
            words = ql._buckets(hashes)
            for i, w in enumerate(words):
                n[w] += 1
                for j in range(max(0, i - ql.REACH), min(len(words), i + ql.REACH + 1)):
                    if j != i:
                        want[w] += index[words[j]]
    assert np.array_equal(table, want) and np.array_equal(counts, n)


def test_index_vectors_are_sparse():
    index = ql.index_vectors()
    assert (np.abs(index).sum(axis=1)[:-1] <= ql.NONZERO).all() and not index[-1].any()


def test_pool_against_brute_force():
    rng = np.random.default_rng(1)
    words = ql.WordVectors(rng.normal(size=(ql.BUCKETS, ql.DIM)).astype(np.float32), rng.random(ql.BUCKETS).astype(np.float32))
    texts = ["a b c a", None, "", "b a, d", "w " * 50_000]
    got = words.pool(pa.array(texts))
    for k, t in enumerate(texts):
        own = np.concatenate([ql._buckets(h) for _, _, h, _, _ in token_hashes(pa.array([t or ""]), RUNS, fold=False)] or [np.zeros(0, np.int64)])
        if not len(own):
            assert not got[k].any()
            continue
        w, v = words.weights[own].astype(float)[:, None], words.vectors[own].astype(float)
        mean = (w * v).sum(axis=0) / w.sum()
        spread = np.sqrt(np.maximum((w * v * v).sum(axis=0) / w.sum() - mean**2, 0))
        assert got[k] == pytest.approx(np.concatenate([mean, spread]), abs=2e-2)


@pytest.fixture(scope="module")
def tables(spark):
    rows = documents(1500, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, quality string")
    return rows, docs, spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2] + [(None, 1), (2, None)], "doc_id long, quality int")


def test_held_out_accuracy_and_calibration(spark, tables):
    rows, docs, labels = tables
    got = {r.doc_id: r for r in ql.score_quality(docs, labels).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    p, y = np.array([got[r[0]].quality for r in held]), np.array([r[3] for r in held])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.05
    assert all(got[r[0]].is_good == (got[r[0]].quality >= 0.5) for r in held)


def test_temperature_is_that_of_the_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 6))
    y = (rng.random(2000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    net = ql.fit(x, y, epochs=80)
    fresh = rng.normal(size=(4000, 6))
    truth = 1 / (1 + np.exp(-1.5 * fresh[:, 0]))
    p = net.probability(fresh)
    for lo, hi in ((0.1, 0.3), (0.4, 0.6), (0.7, 0.9)):  # among those given p, about that share is good
        some = (p >= lo) & (p < hi)
        assert abs(p[some].mean() - truth[some].mean()) < 0.1


def test_odd_rows(spark, tables):
    _, docs, labels = tables
    odd = spark.createDataFrame([(None, "good1 good2", "x"), (70_001, None, "x"), (70_002, "", "x"), (70_003, "junk1 " * 200_000, "x"), (70_004, "both1", "x"), (70_004, "both1", "x")], docs.schema)
    got = [r for r in ql.score_quality(docs.unionAll(odd), labels).collect() if r.doc_id is None or r.doc_id > 70_000]
    assert len(got) == 6 and all(0 <= r.quality <= 1 for r in got)
    by = {r.doc_id: r.quality for r in got}
    assert by[70_001] == by[70_002] and len({r.quality for r in got if r.doc_id == 70_004}) == 1
    assert ql.score_quality(docs.where("false"), labels).count() == 0
    alike = ql.score_quality(docs, labels.where("false")).select("quality").distinct()
    assert alike.count() == 1  # nothing to learn from: one answer for all
