import random

import numpy as np
import pyarrow as pa
import pytest

from sondera.llm import toxicity as tx

BAD = ["vileword", "scumling", "hatefully", "rottener"]
PLAIN = [f"word{k}x" for k in range(300)]


def documents(n, seed, share=0.15):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ed"]))
        rows.append((k, " ".join(words), "x", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    """Only a third of the toxic documents are confirmed; nothing else is labelled."""
    rows = documents(1500, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, toxicity string")
    marked = [(r[0], 1) for r in rows if r[3] and r[0] % 3 == 0]
    labels = spark.createDataFrame(marked + [(None, 1), (3, None)], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(spark, fitted):
    _, docs, labels = fitted
    model = tx.train(docs, labels, prior=0.15)
    fresh = documents(800, 99)
    score = model.score(pa.array([r[1] for r in fresh]))
    toxic = np.array([r[3] for r in fresh], bool)
    assert (score[toxic] > 0.5).mean() > 0.95 and (score[~toxic] > 0.5).mean() < 0.01


def test_unconfirmed_toxic_documents_are_found_too(spark, fitted):
    rows, docs, labels = fitted
    scored = {r.doc_id: r.is_toxic for r in tx.score_toxicity(docs, labels, prior=0.15).collect()}
    toxic = [r[0] for r in rows if r[3] and r[0] % 3]
    clean = [r[0] for r in rows if not r[3]]
    assert np.mean([scored[k] for k in toxic]) > 0.95 and np.mean([scored[k] for k in clean]) < 0.01
    kept = tx.drop_toxic(docs, labels, prior=0.15)
    assert kept.columns == docs.columns  # one of which clashes with the score
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, bad in scored.items() if not bad)


def test_the_risk_is_not_negative():
    """With a prior that is far too large the corrected risk would go below zero without the clamp; unlabelled clean text must stay clean."""
    rng = np.random.default_rng(0)
    clean = [np.unique(rng.integers(100, 200, 20)).astype(np.uint32) for _ in range(400)]
    bad = [np.unique(np.append(rng.integers(100, 200, 20), rng.integers(0, 5, 3))).astype(np.uint32) for _ in range(60)]
    model = tx.fit(bad, clean + bad[:30], 0.3)
    assert np.isfinite(model.weights).all() and (model.weights >= 0).all()
    assert set(model.features) <= set(range(5)) | set(range(100, 200)) and set(range(5)) <= set(model.features)


def test_same_rows_in_any_layout(spark, fitted):
    _, docs, labels = fitted
    a, b = tx.train(docs, labels), tx.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_odd_rows(spark, fitted):
    _, docs, labels = fitted
    odd = spark.createDataFrame([(None, "vileword scumling", "x"), (70_001, None, "x"), (70_002, "", "x"), (70_003, "word1x " * 300_000 + "vileword scumling hatefully", "x"), (70_004, "same", "x"), (70_004, "same", "x")], docs.schema)
    got = [(r.doc_id, r.is_toxic) for r in tx.score_toxicity(docs.unionAll(odd), labels, prior=0.15).collect() if r.doc_id is None or r.doc_id > 70_000]
    assert sorted(got, key=str) == sorted([(None, True), (70_001, False), (70_002, False), (70_003, True), (70_004, False), (70_004, False)], key=str)
    assert tx.score_toxicity(docs.where("false"), labels).count() == 0
    nothing = tx.score_toxicity(docs, labels.where("false"))
    assert nothing.count() == docs.count() and nothing.where("is_toxic").count() == 0
    assert tx.drop_toxic(docs.where("false"), labels.where("false")).count() == 0


def risk(w, b, xp, xu, prior):
    """The corrected risk by its definition, document by document: its positive part, and its negative part before the clamp."""
    def sigmoid(z):
        return 1 / (1 + np.exp(-z))

    def loss(doc, label):  # the sigmoid loss
        return sigmoid(-label * (sum(w[f] for f in doc) + b))

    positive = prior * sum(loss(d, 1) for d in xp) / len(xp)
    return positive, sum(loss(d, -1) for d in xu) / len(xu) - prior * sum(loss(d, -1) for d in xp) / len(xp)


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_gradient_against_the_risk_by_its_definition(prior):
    rng = np.random.default_rng(2)
    xp, xu = ([np.unique(rng.integers(0, 6, rng.integers(1, 4))) for _ in range(n)] for n in (7, 11))
    w, b = rng.normal(size=6), -0.3
    if prior > 0.5:
        xp = [np.array([0, 1])] * 7
        w[:2] = 2.0
    gw, gb, positive, negative = tx.gradient(w, b, xp, xu, prior)
    want = risk(w, b, xp, xu, prior)
    assert (positive, negative) == pytest.approx(want)

    def objective(w, b):
        p, n = risk(w, b, xp, xu, prior)
        return p + n if want[1] >= 0 else -n

    eps = 1e-6
    for k in range(6):
        step = np.eye(6)[k] * eps
        assert gw[k] == pytest.approx((objective(w + step, b) - objective(w - step, b)) / (2 * eps), abs=1e-6)
    assert gb == pytest.approx((objective(w, b + eps) - objective(w, b - eps)) / (2 * eps), abs=1e-6)
    assert (want[1] < 0) == (prior > 0.5)


def test_fit_lowers_the_risk():
    rng = np.random.default_rng(1)
    clean = [np.unique(rng.integers(100, 200, 20)).astype(np.uint32) for _ in range(400)]
    bad = [np.unique(np.append(rng.integers(100, 200, 20), rng.integers(0, 5, 3))).astype(np.uint32) for _ in range(80)]
    model = tx.fit(bad[:40], clean + bad[40:], 40 / 440)
    at = {int(f): k for k, f in enumerate(model.features)}
    rows = [[[at[int(f)] for f in d if int(f) in at] for d in docs] for docs in (bad[:40], clean + bad[40:])]

    def total(w, b):
        p, n = risk(w, b, *rows, 40 / 440)
        return p + max(0, n)

    assert total(model.weights, model.bias) < 0.5 * total(np.zeros(len(model.weights)), -1.0)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_estimated_prior(share):
    rows = documents(3000, 4, share)
    lists = [np.frombuffer(x.as_py(), np.uint32) for o in tx._features([pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array([r[1] for r in rows])], names=["a", "b"])]) for x in o.column(1)]
    positive = [x for x, r in zip(lists, rows, strict=True) if r[3]][:150]
    assert tx.estimated_prior(positive, lists) == pytest.approx(np.mean([r[3] for r in rows]), abs=0.05)
    assert tx.estimated_prior(positive[:2], lists) == 0 and tx.estimated_prior(lists[:50], lists) <= 0.95


def test_confirmed_positives_alone_are_enough(spark):
    """60 of 300 are toxic, 30 of them confirmed, nothing else is labelled: with the default prior all are found, and no clean one."""
    rows = documents(3000, 7)
    toxic = [r for r in rows if r[3]][:60]
    rows = toxic + [r for r in rows if not r[3]][:240]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(r[0], 1) for r in toxic[::2]], "doc_id long, toxic int")
    scored = {r.doc_id: r.is_toxic for r in tx.score_toxicity(docs, labels).collect()}
    assert np.mean([scored[r[0]] for r in toxic]) > 0.95 and np.mean([scored[r[0]] for r in rows if not r[3]]) < 0.02


def test_texts_without_features_are_never_toxic(spark):
    model = tx.Model(np.array([5], np.uint32), np.array([1.0]), 0.35)  # a bias above 0, as of a large prior
    assert model.score(pa.array([None, "", "clean words"])).tolist() == [0.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, Text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert tx.score_toxicity(df, labels).first().is_toxic is False and tx.drop_toxic(df, labels).columns == df.columns
    with pytest.raises(TypeError, match="must have integers"):
        tx.score_toxicity(spark.createDataFrame([("a", "b")], "doc_id string, text string"), labels)
