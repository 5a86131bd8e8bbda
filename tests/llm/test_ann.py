import numpy as np
import pytest

from sondera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, cell string, floor string"


def clustered(n, dim, groups, seed, noise=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def by_brute_force(ids, x, k):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    out = {}
    for row, i in enumerate(ids):
        order = [j for j in np.lexsort((ids, -np.round(sims[row], 9))) if j != row][:k]
        out[int(i)] = [(int(ids[j]), sims[row, j]) for j in order]
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.rank] = (r.neighbour, r.similarity)
    return {i: [v[k] for k in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize(("n", "groups"), [(1500, 12), (1200, 1)])
def test_recall_for_every_query(spark, n, groups):
    x = clustered(n, 32, groups, 3)
    ids = np.random.default_rng(1).permutation(n * 3)[:n].astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist(), "c", None) for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(6)
    got, want = collected(ann.nearest(df, every=1, block=200)), by_brute_force(ids, x, ann.K)
    assert got.keys() == want.keys() and all(len(v) == ann.K for v in got.values())
    recall = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / ann.K for i in want])
    assert recall >= 0.9
    true = dict(zip(ids.tolist(), x.astype(np.float64), strict=True))
    for i in list(got)[::50]:  # similarities are exact, in order
        assert [s for _, s in got[i]] == pytest.approx([float(true[i] @ true[j] / np.linalg.norm(true[i]) / np.linalg.norm(true[j])) for j, _ in got[i]], abs=2e-6)
        assert [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)


def test_all_cells_and_wide_bounds_are_exact(spark):
    x = clustered(400, 16, 5, 8)
    ids = np.arange(400)
    df = spark.createDataFrame([(int(i), v.tolist(), "c", None) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got, want = collected(ann.nearest(df, k=5, every=1, coverage=1.0, epsilon=50.0)), by_brute_force(ids, x, 5)
    share = np.mean([[j for j, _ in got[i]] == [j for j, _ in want[i]] for i in want])
    assert share > 0.97


def an_index(dim, seed):
    rng = np.random.default_rng(seed)
    return ann.Index(rng.normal(size=(1, dim)) * 0.05, np.linalg.qr(rng.normal(size=(dim, dim)))[0], 1), rng


@pytest.mark.parametrize("dim", [64, 60])
def test_estimates_and_their_bounds(dim):
    """One-bit estimates are unbiased over rotations, and the bound of epsilon holds for nearly all pairs."""
    means = []
    for seed in range(12):
        index, rng = an_index(dim, seed)
        x, q = ann.unit(rng.normal(size=(500, dim))), ann.unit(rng.normal(size=(50, dim)))
        packed, scalars = index.code(x, 0)
        assert packed.shape == (500, -(-dim // 8)) and packed.dtype == np.uint8
        behind = index.behind(packed, scalars).T
        error = index.ahead(q, 0, 0.0) @ behind - q @ x.T
        slack = index.ahead(q, 0, ann.EPSILON) @ behind - index.ahead(q, 0, 0.0) @ behind
        means.append(error.mean())
        assert (np.abs(error) <= slack).mean() > 0.99
        assert (np.abs(error) <= slack * 0.5 / ann.EPSILON).mean() < 0.9  # and it isn't idle
    assert abs(np.mean(means)) < 1.5e-3


def test_candidates_are_those_whose_bound_reaches_the_floor():
    index, rng = an_index(32, 6)
    x, q = ann.unit(rng.normal(size=(300, 32))), ann.unit(rng.normal(size=(40, 32)))
    packed, scalars = index.code(x, 0)
    floors = np.linspace(-0.5, 1.5, 40)
    query, place = ann.candidates(index, 0, q, floors, packed, scalars, None, ann.EPSILON)
    upper = index.ahead(q, 0, ann.EPSILON) @ index.behind(packed, scalars).T
    want = {(i, j) for i in range(40) for j in range(300) if upper[i, j] >= floors[i] - 1e-5}
    assert want == set(zip(query.tolist(), place.tolist(), strict=True)) and 0 < len(want) < 6000
    query, place = ann.candidates(index, 0, q, floors, packed, scalars, 3, ann.EPSILON)
    assert np.bincount(query).tolist() == [3 * ann.FEW] * 40
    assert ann.candidates(index, 0, q[:0], floors[:0], packed, scalars, None, 3.0)[0].shape == (0,)


def test_queries_are_the_rows_with_divisible_ids(spark):
    x = clustered(900, 24, 6, 4)
    ids = np.arange(900) * 7
    df = spark.createDataFrame([(int(i), v.tolist(), "c", None) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got, want = collected(ann.nearest(df)), by_brute_force(ids, x, ann.K)
    assert set(got) == {int(i) for i in ids if i % ann.EVERY == 0}
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / ann.K for i in got]) >= 0.9
    assert any(j % ann.EVERY for v in got.values() for j, _ in v)  # against all rows
    assert ann.nearest(df.where("vec_id % 100 <> 0")).count() == 0


def test_a_cell_of_copies(spark):
    """A third of the rows are one vector: their blocks are spread over tasks, and ties go to the least ids."""
    x = clustered(600, 16, 3, 9)
    x[::3] = x[0]
    df = spark.createDataFrame([(k, v.tolist(), "c", None) for k, v in enumerate(x)], SCHEMA).repartition(5)
    got = collected(ann.nearest(df, k=4, every=50, coverage=1.0, block=32, slice_of=64))
    for i, found in got.items():
        if i % 3 == 0:
            assert found == [(j, 1.0) for j in [0, 3, 6, 9, 12] if j != i][:4]


def test_odd_rows_and_ties(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(k, one, "c", None) for k in range(1, 6)] + [(3, one, "c", None), (None, one, "c", None), (10, None, "c", None), (11, [0.0] * 4, "c", None), (12, [1.0, 2.0], "c", None), (13, [float("nan")] + one[1:], "c", None), (14, [1.0, None, 0.0, 0.0], "c", None), (15, [0.0, 1.0, 0.0, 0.0], "c", None)]
    got = collected(ann.nearest(spark.createDataFrame(rows, SCHEMA), k=2, every=1, coverage=1.0))
    assert got[1] == [(2, 1.0), (3, 1.0)] and got[3] == [(1, 1.0), (2, 1.0)] and set(got) == {1, 2, 3, 4, 5, 15}
    empty = ann.nearest(spark.createDataFrame(rows, SCHEMA).where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "neighbour", "rank", "similarity"]
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0  # nobody else is there


@pytest.mark.parametrize(("dim", "groups", "noise"), [(24, 1, 5.0), (24, 200, 0.6)])
def test_probes_hold_for_vectors_that_no_sample_has(spark, dim, groups, noise):
    """On a table much larger than the samples, the probed cells hold the wanted share of the neighbours of all vectors, and each cell has enough vectors to place it."""
    n = 8000
    x = clustered(n, dim, groups, 4, noise)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vec array<double>").repartition(4)
    index = ann.build(df, coverage=0.9, most_trained=60, most_measured=200)
    assert len(index.centroids) == int(np.sqrt(n) / 2)
    x = ann.unit(x.astype(np.float64))
    some = np.arange(0, n, 8)
    sims = x[some] @ x.T
    sims[np.arange(len(some)), some] = -np.inf
    best = np.argpartition(-sims, 10, axis=1)[:, :10]
    place = np.argsort(index.ranked(x[some]), axis=1)
    share = (np.take_along_axis(place, index.home(x)[best], axis=1) < index.probes).mean()
    assert share >= 0.88
    got = np.bincount(index.home(x), minlength=len(index.centroids))
    assert got.min() > 0 and index.probes < len(index.centroids)


def test_the_measured_queries_are_not_trained_on(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(ann, "centroids", lambda sample, cells, real=ann.centroids: seen.setdefault("sample", sample) is None or real(sample, cells))
    real = ann._nearest_of_sample
    monkeypatch.setattr(ann, "_nearest_of_sample", lambda q, i, dim, k: seen.setdefault("queries", q) is None or real(q, i, dim, k))
    x = clustered(4000, 8, 3, 2)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vec array<double>")
    index = ann.build(df, most_trained=10, most_measured=50)
    assert len(seen["queries"]) == 50 and len(seen["sample"]) == ann.PER_CELL * len(index.centroids)
    assert not {v.tobytes() for v in seen["sample"]} & {v.tobytes() for v in seen["queries"]}
