import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import vector as v
from sondera.operators import maintenance as m
from sondera.operators import search as s

VECS = "vec_id long, note_id long, start_i long, end_i long, vec array<float>"


def vecs(spark, rows):
    return spark.createDataFrame([(k, n, a, b, [float(x) for x in x]) for k, (n, a, b, x) in enumerate(rows)], VECS)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [([1, 0, 0], [0, 1, 0], 0), ([1, 2, 3], [1, 2, 3], 1), ([1, 0, 0], [-1, 0, 0], -1), ([1, 0, 0], [1, 1, 0], 0.70710677), ([1, 2, 3], [1, 1, 1], 0.9258201), ([0, 0, 0], [1, 2, 3], 0)],
)
def test_cosine(spark, a, b, expected):
    row = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<float>, b array<float>").select(v.cosine_similarity(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(expected, abs=1e-6)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "a array<float>")
    got = df.select(v.magnitude(F.col("a")), v.is_zero(F.col("a")), v.normalize(F.col("a")), v.dimension(F.col("a")), v.dot(F.col("a"), F.col("a"))).collect()
    assert got[0][0] == 5 and not got[0][1] and got[0][2] == pytest.approx([0.6, 0.8]) and got[0][3] == 2 and got[0][4] == 25
    assert got[1][0] == 0 and got[1][1] and got[1][2] is None
    assert got[2][1] and got[3][0] is None and got[3][4] is None
    other = df.select(v.dot(F.col("a"), F.array(F.lit(1.0)))).first()
    assert other[0] is None  # of different lengths


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<float>>, m array<int>")
    got = [r[0] for r in df.select(v.masked_mean(F.col("t"), F.col("m"))).collect()]
    assert got == [[2.0, 4.0], None]


def test_search_order_and_strict_threshold(spark):
    rows = vecs(spark, [(10, 0, 5, [1, 0, 0]), (20, 5, 10, [0.9, 0.1, 0]), (30, 10, 15, [0, 1, 0])])
    q = s.literal([1.0, 0.0, 0.0])
    assert [r.note_id for r in s.top_k(s.score(rows, q), 10, 0.5).orderBy("rank").collect()] == [10, 20]
    hot = vecs(spark, [(k, 0, 1, [1.0 if j == k else 0.0 for j in range(50)]) for k in range(50)])
    found = s.top_k(s.score(hot, s.literal([1.0] + [0.0] * 49)), 100, 0.0).collect()
    assert len(found) == 1 and found[0].similarity == 1.0


def test_null_vector_takes_no_slot(spark):
    rows = vecs(spark, [(1, 0, 1, [1, 0])]).unionAll(spark.createDataFrame([(9, 2, 0, 1, None)], VECS))
    assert [r.note_id for r in s.top_k(s.score(rows, s.literal([1.0, 0.0])), 1, 0.1).collect()] == [1]


def test_unique_limits_before_it_chooses(spark):
    rows = vecs(spark, [(1, k, k + 1, [1, 0]) for k in range(3)] + [(2, 0, 1, [0.9, 0])])
    notes = spark.createDataFrame([(1, "a"), (2, "b")], "note_id long, path string")
    assert [r.path for r in s.unique_search(rows, notes, s.literal([1.0, 0.0]), 3, 0.0).collect()] == ["a"]
    assert [r.path for r in s.unique_search(rows, notes, s.literal([1.0, 0.0]), 4, 0.0).orderBy("rank").collect()] == ["a", "b"]


def test_row_without_a_path_goes_and_ranks_close_up(spark):
    rows = vecs(spark, [(7, 0, 1, [1, 0]), (1, 0, 1, [0.9, 0])])
    notes = spark.createDataFrame([(1, "a")], "note_id long, path string")
    assert [(r.rank, r.path) for r in s.search(rows, notes, s.literal([1.0, 0.0]), 5, 0.0).collect()] == [(1, "a")]


def test_plans(spark):
    rows = vecs(spark, [(1, 0, 1, [1, 0])])
    plan = s.top_k(s.score(rows, s.literal([1.0, 0.0])), 5, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vec array<float>")
    plan = s.search_batch(rows, queries, 5, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_maintenance(spark):
    rows = vecs(spark, [(1, 0, 5, [1, 0]), (1, 5, 9, [0, 1]), (2, 0, 3, [1, 1])])
    one = spark.createDataFrame([(1,)], "note_id long")
    assert m.remove_by_note(rows, one).count() == 1
    assert sorted(r.vec_id for r in m.copy_vector(rows, 2, 77).collect()) == [0, 1, 2, 77]
    assert m.copy_vector(rows, 99, 77).count() == 3
    assert [r.start_i for r in m.vecs_for_note(rows, 1).collect()] == [0, 5]
    assert m.overlaps(rows).count() == 0
    more = vecs(spark, [(1, 5, 10, [1, 0]), (1, 5, 5, [0, 1]), (1, 9, 12, [0, 1]), (2, 9, 12, [0, 1])])
    assert [(r.vec_a, r.vec_b) for r in m.overlaps(more).collect()] == [(0, 2)]  # an empty interval at the start overlaps nothing


def test_ids_are_monotonic_and_in_order(spark):
    known = spark.createDataFrame([(1, "m")], "note_id long, path string")
    paths = spark.createDataFrame([("z",), ("a",), ("m",), ("a",)], "path string")
    got = {r.path: r.note_id for r in m.get_or_create_ids(known, paths, 5).collect()}
    assert got == {"m": 1, "a": 5, "z": 6}


def test_unit_vectors(spark):
    from sondera.plans.generate import generate_notes, random_unit_vectors

    rows = random_unit_vectors(spark, 50, 8).collect()
    assert all(math.isclose(sum(x * x for x in r.vec), 1, abs_tol=1e-5) for r in rows) and rows == random_unit_vectors(spark, 50, 8).collect()
    assert generate_notes(spark, 3).count() == 3


def test_batch_search_without_a_broadcast(spark):
    """Blocks of several dimensions over all slots: as many rows as by hand, and no shuffle on the dimension alone."""
    rng = __import__("random").Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3 if k % 4 else 2)]) for k in range(60)]
    held = spark.createDataFrame(rows, "vec_id long, vec array<float>").repartition(6)
    asked = spark.createDataFrame(rows[:9], "query_id long, vec array<float>").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = s.search_batch(held, asked, 3, -1e9)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("slot" in k for k in keys) and not any("dim" in k and "slot" not in k for k in keys) and "Cartesian" not in plan and "NestedLoop" not in plan
    for q, x in rows[:9]:
        sims = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)), 5), k) for k, y in rows if len(y) == len(x))
        assert [k for _, k in sims[:3]] == [got[q][n] for n in (1, 2, 3)]


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_overlaps_against_all_pairs(spark, width):
    rng = __import__("random").Random(width)
    rows = []
    for k in range(120):
        start = rng.randrange(60)
        rows.append((k, k % 3, start, start + rng.choice([0, 0, 1, 2, 5, 40])))
    df = spark.createDataFrame(rows, "vec_id long, note_id long, start_i long, end_i long")
    want = {(n, a, b) for a, n, s1, e1 in rows for b, n2, s2, e2 in rows if n == n2 and a < b and s1 < e2 and s2 < e1}
    got = [tuple(r) for r in m.overlaps(df, width).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_batch_search_of_equal_vectors(spark):
    """A block of copies sends on k rows, not all that tie."""
    held = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(300, 0, -1)], "vec_id long, vec array<float>").repartition(4)
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vec array<float>")
    assert [(r.rank, r.vec_id) for r in s.search_batch(held, asked, 3, 0.5).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_batch_search_against_a_double_product(spark):
    """More rows than a product has, equal vectors, lengths from tiny to huge and what isn't finite: as by one product in double precision."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 9)).astype(np.float32)
    x[300:340] = x[7]
    x[400:420] *= np.float32(1e-20)
    x[420:430] *= np.float32(1e19)
    x[5, 2] = np.nan
    held = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, vec array<float>").repartition(5)
    asked = held.withColumnRenamed("vec_id", "query_id")
    for threshold in (-1e40, 0.5):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in s.search_batch(held, asked, 4, threshold).collect()}
        sims = np.nan_to_num(x.astype(float) @ x.T.astype(float), nan=-np.inf)
        want = {}
        for q, row in enumerate(sims):
            for rank, k in enumerate(sorted(np.flatnonzero(row > threshold), key=lambda k: (-round(row[k], 6), k))[:4], 1):
                want[q, rank] = int(k)
        assert {at: k for at, (k, _) in got.items() if at[0] not in range(400, 430)} == {at: k for at, k in want.items() if at[0] not in range(400, 430)}
        assert got.keys() == want.keys()
        assert all(sims[q, got[q, n][0]] == pytest.approx(sims[q, k], rel=1e-9) for (q, n), k in want.items())


def test_batch_search_sends_few_rows_to_the_window(spark):
    """All vectors ask: what is ranked doesn't grow with the product of the blocks of both sides, but with the groups."""
    from sondera.plans.generate import random_unit_vectors

    x = random_unit_vectors(spark, 3000, 4).cache()
    found = s.search_batch(x, x.withColumnRenamed("vec_id", "query_id"), 5, -2.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == 15_000


@pytest.mark.parametrize("k", [4, 300])
def test_all_vectors_search_each_other(spark, k):
    """Two dimensions, equal vectors, lengths from tiny to huge, what isn't finite, and groups of fewer than k: as all queries by ``search_batch``, and as by hand."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1700, 9)).astype(np.float32)
    x[300:340] = x[7]
    x[400:410] *= np.float32(1e-20)
    x[410:415] *= np.float32(1e19)
    x[5, 2] = np.nan
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1700 + k, rng.normal(size=2).tolist()) for k in range(30)] + [(1730, None), (1731, [])]
    held = spark.createDataFrame(rows, "vec_id long, vec array<float>").repartition(5)
    for threshold in (-1e40, 0.5):
        got, want = ({(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in found.collect()} for found in (s.search_all(held, k, threshold), s.search_batch(held, held.withColumnRenamed("vec_id", "query_id"), k, threshold)))
        assert got.keys() == want.keys() and all(got[at][1] == pytest.approx(want[at][1], rel=1e-9) for at in got)
        assert all(got[at][0] == want[at][0] for at in got if at[0] not in range(400, 415))
        sims = np.nan_to_num(x.astype(float) @ x.T.astype(float), nan=-np.inf)
        for q in (0, 5, 7, 320, 1699):
            best = sorted(np.flatnonzero(sims[q] > threshold), key=lambda j, q=q: (-round(sims[q, j], 6), j))[:k]
            assert [got[q, n][0] for n in range(1, len(best) + 1)] == best and (q, len(best) + 1) not in got
