import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from sondera.llm import exact_dedup as x


def by_text(texts):
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(t, []).append(k)
    return sorted(g for g in groups.values() if len(g) > 1)


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.binary(max_size=40).map(lambda b: bytes(c % 3 for c in b)), max_size=40))
def test_radix_split(texts):
    assert sorted(x.radix_split(texts)) == by_text(texts)


def test_radix_split_of_long_shared_beginnings():
    base = bytes(200_000)
    texts = [base + bytes([k % 5]) for k in range(20)] + [base, base[:-1]]
    assert sorted(x.radix_split(texts)) == by_text(texts)


SCHEMA = "doc_id long, text string, size string, head string, c0 string"


def corpus():
    rng = random.Random(2)
    texts = ["", "", "a", "b" * 100, "b" * 100, "b" * 99 + "c", "é" * 70, "é" * 70, "x" * 300_000, "x" * 300_000, "x" * 299_999 + "y"]
    texts += [("header " * 20) + str(rng.randrange(30)) for _ in range(300)] + ["copy"] * 500
    rows = [(k, t, "s", None, "z") for k, t in enumerate(texts)]
    rows += [(None, "copy", None, None, None), (None, "alone", None, None, None), (3, "b" * 100, "s", None, "z"), (9001, None, None, None, None), (9002, None, "s", "h", "c")]
    rng.shuffle(rows)
    return rows


def key(i):
    return (i is None, i or 0)


@pytest.mark.parametrize(("partitions", "bound"), [(1, x.BOUND), (7, x.BOUND), (5, 2000), (3, 0)])
def test_pairs_and_rows_against_brute_force(spark, partitions, bound):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r[0])
    want = []
    for ids in groups.values():
        ids = sorted(ids, key=key)
        want += [(i, ids[0]) for i in ids[1:]]
    got = [tuple(r) for r in x.exact_duplicates(df, bound=bound).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = x.exact_dedup(df, bound=bound)
    assert kept.columns == df.columns and kept.schema == df.schema
    ids = sorted([r.doc_id for r in kept.collect()], key=key)
    assert ids == sorted([min(g, key=key) for g in groups.values()] + [9001, 9002], key=key)


def test_empty_and_small_batches(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert x.exact_duplicates(df.where("false")).count() == 0 and x.exact_dedup(df.where("false")).count() == 0
    want = x.exact_duplicates(df).count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs of equal keys cross batches
    try:
        assert x.exact_duplicates(df.repartition(3)).count() == want
        assert x.exact_dedup(df.repartition(3)).count() == len(corpus()) - want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("names", [("tags", "doc_id", "text"), ("tags", "text", "doc_id")])
def test_the_first_column_may_be_an_array(spark, names):
    """One long run of equal texts, of more than a batch, in tables that begin with an array."""
    rows = [{"tags": [k, -k], "doc_id": k, "text": "same" if k % 3 else "also"} for k in range(50)]
    kinds = {"tags": "array<long>", "doc_id": "long", "text": "string"}
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows[::-1]], ", ".join(f"{n} {kinds[n]}" for n in names)).repartition(8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted((r.doc_id, r.text, list(r.tags)) for r in x.exact_dedup(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(0, "also", [0, 0]), (1, "same", [1, -1])]


@pytest.mark.parametrize(("adaptive", "bound"), [("true", x.BOUND), ("false", 3000)])
def test_columns_of_any_kind_in_any_place(spark, adaptive, bound):
    """Arrays, maps, structs, and names that differ in case only or that the operator uses itself."""
    kinds = [("tags", "array<long>"), ("doc_id", "long"), ("m", "map<string,long>"), ("text", "string"), ("Text", "string"), ("s", "struct<a:long,b:array<string>>"), ("size", "int"), ("head", "binary"), ("number", "string")]
    rows = [([k], k, {"x": k}, "t" * 70 + str(k % 9), f"T{k}", (k, [str(k)]), k, bytes([k % 256]), None) for k in range(400)]
    for turn in (0, 1, 4):
        order = kinds[turn:] + kinds[:turn]
        df = spark.createDataFrame([r[turn:] + r[:turn] for r in rows[::-1]], ", ".join(f"{n} {t}" for n, t in order)).repartition(4)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        try:
            kept = x.exact_dedup(df, bound=bound)
            assert kept.columns == df.columns and [f.dataType for f in kept.schema] == [f.dataType for f in df.schema]
            at = [n for n, _ in order].index("doc_id")
            assert {r[at]: tuple(r) for r in kept.collect()} == {r[1]: tuple(r[turn:] + r[:turn]) for r in rows[:9]}
            assert sorted(map(tuple, x.exact_duplicates(df, bound=bound).collect())) == [(k, k % 9) for k in range(9, 400)]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_cluster_splits_large_groups_again(spark):
    """Texts of one length with one header of 2,000 bytes: no task gets a group over the bound, but for one of equal texts."""
    texts = ["h" * 2000 + f"{k:04d}" + "t" * 3000 for k in range(300)] + ["h" * 5004] * 100
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", x.F.col("text").cast("binary"))
    seen, ends = 0, 0
    for part, width, ended in x.levels(rows, "text", 50_000):
        groups = part.groupBy("size", "head").agg(x.F.count("*").alias("n"), x.F.count_distinct("text").alias("kinds")).collect()
        seen += sum(g.n for g in groups)
        for g in groups:
            assert (g.kinds == 1) if ended else g.n * (g["size"] + x.HEAD) <= 50_000
            ends += ended
    assert seen == 400 and ends == 1


def test_other_ids_are_refused(spark):
    for run in (x.exact_duplicates, x.exact_dedup):
        with pytest.raises(TypeError, match="doc_id must have integers"):
            run(spark.createDataFrame([("a", "t")], "doc_id string, text string"))
        with pytest.raises(ValueError, match="no column"):
            run(spark.createDataFrame([(1,)], "doc_id long"))
