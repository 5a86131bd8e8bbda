import random

import pytest

from sondera.operators.embedder import HashingEmbedder, ModelEmbedder
from sondera.plans import relevance as r
from sondera.sources import store as st
from sondera.functions.tokenizer import Vocabulary
from sondera.operators.embedder import TokenEmbedder
from sondera.plans import fuzz
from sondera.streaming.ingest import Full, IngestQueue, NotQueuedShuttingDown

E = HashingEmbedder(64, 0.3, 0.8)


def docs(spark, rows):
    return spark.createDataFrame(rows, "path string, contents string")


@pytest.fixture
def store(spark, tmp_path):
    return st.VectorStore.open(spark, str(tmp_path / "store"), E)


def test_pizza_offsets(spark, store):
    store.ingest(docs(spark, [("p", "pizza. pizza. pizza.")]))
    got = store.search("pizza").orderBy("rank").collect()
    assert [(x.start_i, x.end_i) for x in got] == [(0, 5), (7, 12), (14, 19)]
    assert [x.path for x in store.unique_search("pizza").collect()] == ["p"]


def test_replace_rename_remove_prune(spark, store):
    store.ingest(docs(spark, [("a", "apple. banana. cherry."), ("b", "banana."), ("empty", "")]))
    assert store.count() == 3 and store.vectors().count() == 4
    before = store.get_id("a")
    store.ingest(docs(spark, [("a", "apple. dragonfruit. cherry.")]))
    assert store.get_id("a") == before and store.search("banana").count() == 1 and store.search("dragonfruit").count() == 1
    store.validate()
    store.rename("a", "z")
    assert store.get_path(before) == "z" and store.get_id("a") is None
    with pytest.raises(st.NotFound):
        store.rename("gone", "x")
    with pytest.raises(st.PathExists):
        store.rename("b", "z")
    for bad in ((None, "x"), ("b", "")):
        with pytest.raises(st.InvalidPath):
            store.rename(*bad)
    store.remove("nowhere")
    store.remove("b")
    assert store.count() == 2 and store.search("banana").count() == 0
    store.prune(spark.createDataFrame([("empty",)], "path string"))
    assert store.count() == 1 and store.vectors().count() == 0
    again = st.VectorStore.open(spark, store.path, E)
    assert again.count() == 1 and again.vectors().count() == 0
    again.ingest(docs(spark, [("new", "kiwi pie.")]))
    assert again.get_id("new") > before  # ids aren't used again


def test_cap(spark, store):
    store.ingest(docs(spark, [(f"n{k}", "brick") for k in range(150)]))
    assert store.search("brick", 100).count() == 100 and store.unique_search("brick", 100).count() == 100


def test_low_value_and_empty_inputs(spark, store):
    store.ingest(docs(spark, [("a", " "), ("b", "  "), ("c", " \n\r\t "), ("d", "a#")]))
    assert store.vectors().count() == 0 and store.count() == 4
    assert store.search("").count() == 0 and store.search("a").count() == 0 and store.search("x", 0).count() == 0
    with pytest.raises(st.InvalidPath):
        store.ingest(docs(spark, [("", "x")]))
    with pytest.raises(st.InvalidPath):
        store.remove("")
    with pytest.raises(st.DuplicatePath):
        store.ingest(docs(spark, [("q", "x"), ("q", "y")]))


def test_highlights(store):
    assert store.highlights("hello", "bah hello") == [(4, 9)]
    assert store.highlights("hello", "hello; hello ") == [(0, 5), (7, 12)]
    assert store.highlights("hello", "hello; hello ", 1) == [(0, 5)]
    assert store.highlights("", "hello") == [] and store.highlights("hello", "hello", 0) == []


def test_incompatible(spark, store):
    store.ingest(docs(spark, [("a", "apple.")]))
    with pytest.raises(st.IncompatibleStore):
        st.VectorStore.open(spark, store.path, HashingEmbedder(32))


def test_vector_operations(spark, store):
    store.ingest(docs(spark, [("a", "apple. banana.")]))
    first = store.vectors().orderBy("vec_id").first()
    assert len(store.get_vector(first.vec_id)) == 64 and store.vecs_for_note(first.note_id).count() == 2
    new = store.copy_vector(first.vec_id)
    assert store.vectors().count() == 3 and store.copy_vector(999) is None
    with pytest.raises(st.OverlappingVectors):
        store.validate()
    store.remove_vector(new)
    store.validate()
    with pytest.raises(st.MultipleRemove):
        store.remove_vector(new)
    store.compact()
    store.vacuum()
    assert store.stats()["parts"] == 1 and store.vectors().count() == 2 and store.get_id("a") == first.note_id


def test_batch_search(spark, store):
    store.ingest(docs(spark, [("a", "apple pie."), ("b", "banana split.")]))
    asked = spark.createDataFrame([(1, "apple pie"), (2, "banana split"), (3, "?")], "query_id int, query string")
    assert {(x.query_id, x.rank, x.path) for x in store.search_batch(asked, 1).collect()} == {(1, 1, "a"), (2, 1, "b")}


def test_churn_against_a_dictionary(spark, store):
    rng, words, model = random.Random(9), "apple banana cherry date elder fig grape".split(), {}
    for _ in range(8):
        kind, path = rng.choice(["ingest", "ingest", "remove", "rename"]), f"p{rng.randrange(4)}"
        if kind == "ingest":
            text = ". ".join(rng.sample(words, rng.randrange(4)))
            store.ingest(docs(spark, [(path, text)]))
            model[path] = text
        elif kind == "remove":
            store.remove(path)
            model.pop(path, None)
        elif path in model and "moved" not in model:
            store.rename(path, "moved")
            model["moved"] = model.pop(path)
        store = st.VectorStore.open(spark, store.path, E)
        store.validate()
    rows = store.vectors().join(store.notes(), "note_id").groupBy("path").count().collect()
    assert {x.path: x["count"] for x in rows} == {p: len(t.split(". ")) for p, t in model.items() if t}
    assert {x.path for x in store.notes().collect()} == set(model)


def test_queue_latest_wins_and_drains(spark, store, tmp_path):
    queue = IngestQueue(store, str(tmp_path / "queue"))
    for k in range(6):
        queue.push(f"p{k % 3}", f"word{k}.")
    with pytest.raises(st.InvalidPath):
        queue.push("", "x")
    queue.shutdown()
    with pytest.raises(NotQueuedShuttingDown):
        queue.push("p", "x")
    assert store.count() == 3 and store.search("word5").count() == 1 and store.search("word0").count() == 0
    snapshot = store.stats()["snapshot"]
    queue.drain()  # nothing is pending
    assert store.stats()["snapshot"] == snapshot


def test_a_batch_that_comes_again_is_skipped(spark, store):
    store.ingest(docs(spark, [("a", "apple.")]), "s", 0)
    store.ingest(docs(spark, [("b", "banana.")]), "s", 0)
    assert store.count() == 1


def test_model_embedder(spark):
    import numpy as np

    model = ModelEmbedder("toy", 3, 0.1, 0.5, lambda: lambda texts: np.array([[len(x), 0, 0] if x != "zero" else [0, 0, 0] for x in texts], float))
    rows = spark.createDataFrame([("ab",), ("",), (None,), ("zero",)], "s string").select(model.embed(__import__("pyspark").sql.functions.col("s")).alias("v")).collect()
    assert [x.v for x in rows] == [[1.0, 0.0, 0.0], None, None, None] and model.embed_one("q") == [1.0, 0.0, 0.0]


def test_scores(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "x")], "query_id int, rank int, path string")
    wanted = spark.createDataFrame([(1, "a"), (2, "c"), (3, "y"), (4, "z")], "query_id int, want string")
    assert {x.query_id: x.got for x in r.binary_scores(results, wanted).collect()} == {1: 20, 2: 40, 3: 0, 4: 0}
    expected = spark.createDataFrame([(1, "a", True, 10), (1, "q", False, 10), (1, "b", False, 10)], "query_id int, path string, include boolean, weight int")
    assert r.inclusion_scores(results, expected).first().got == 20
    assert r.report(r.first_hit_scores(results, expected.where("include").select("query_id", "path", "weight")), "f").first().percent == 100.0


def test_the_last_push_wins_after_a_restart(spark, store, tmp_path):
    folder = str(tmp_path / "queue")
    first = IngestQueue(store, folder)
    for k in range(3):
        first.push("p", f"old{k}.")
    again = IngestQueue(store, folder)
    again.push("p", "newest.")
    again.drain()
    assert store.search("newest").count() == 1 and store.count() == 1 and not any(store.search(f"old{k}").count() for k in range(3))
    assert not again._names()  # what is taken in doesn't stay
    third = IngestQueue(store, folder)
    third.push("p", "latest.")
    third.shutdown()
    assert store.search("latest").count() == 1 and store.search("newest").count() == 0


def test_a_full_queue(spark, store, tmp_path):
    queue = IngestQueue(store, str(tmp_path / "queue"), capacity=2)
    queue.push("a", "x1.")
    queue.push("b", "x2.")
    with pytest.raises(Full):
        queue.push("c", "x3.")
    queue.push("a", "x4.")  # a path that is pending is only replaced
    queue.drain()
    queue.push("c", "x5.")
    queue.shutdown()
    assert sorted(r.path for r in store.notes().collect()) == ["a", "b", "c"] and store.search("x4").count() == 1 and store.search("x1").count() == 0


def test_a_queue_that_works_in_the_background(spark, store, tmp_path):
    queue = IngestQueue(store, str(tmp_path / "queue"))
    running = queue.run()
    for k in range(4):
        queue.push(f"p{k % 2}", f"word{k}.")
    queue.drain()
    assert running.isActive and store.search("word3").count() == 1 and store.search("word0").count() == 0
    queue.push("p9", "word9.")
    queue.shutdown()
    assert not running.isActive and store.search("word9").count() == 1 and not queue._names()
    with pytest.raises(NotQueuedShuttingDown):
        queue.push("p", "x")


def counting(folder):
    """A model that leaves a line for every text that it gets."""

    def load():
        import os
        import uuid

        import numpy as np

        def model(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    return load


def test_each_chunk_goes_to_the_model_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    store = st.VectorStore.open(spark, str(tmp_path / "store"), ModelEmbedder("count", 2, 0.1, 0.5, counting(str(seen))))
    rows = [(f"p{k:03d}", ". ".join(f"sentence {k} {j}" for j in range(5))) for k in range(40)]
    store.ingest(docs(spark, rows).repartition(5))
    sent = [line for f in seen.iterdir() for line in f.read_text().split("\n")]
    assert len(sent) == 200 == len(set(sent)) and store.vectors().count() == 200
    for f in seen.iterdir():
        f.unlink()
    asked = spark.createDataFrame([(k, f"query {k}") for k in range(30)], "query_id int, query string")
    assert store.search_batch(asked, 2).count() == 60
    assert len([line for f in seen.iterdir() for line in f.read_text().split("\n")]) == 30


def test_another_writer_is_refused(spark, store):
    other = st.VectorStore.open(spark, store.path, E)
    store.ingest(docs(spark, [("a", "apple.")]))
    with pytest.raises(st.ConcurrentWrite):
        other.ingest(docs(spark, [("b", "banana.")]))
    fresh = st.VectorStore.open(spark, store.path, E)
    assert fresh._files.claim("lock")  # a writer that died
    with pytest.raises(st.ConcurrentWrite):
        fresh.remove("a")
    fresh.unlock()
    fresh.remove("a")
    assert fresh.count() == 0 and store.count() == 1  # a reader keeps its snapshot


def test_parts_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(st, "MOST_PARTS", 3)
    store.ingest(docs(spark, [("big", ". ".join(f"long{k} text" for k in range(40)))]))
    first = store._meta["vectors"][0]
    for k in range(5):
        store.ingest(docs(spark, [(f"p{k}", f"word{k}."), ("p0", f"again{k}.")] if k else [("p0", "first.")]))
        store.rename(f"p{k}", f"q{k}") if k else None
    assert store._meta["vectors"][0] == first and set(store._meta["rows"]) == {*store._meta["notes"], *store._meta["vectors"]}  # the large part isn't written again
    assert max(len(store._meta[kind]) for kind in ("notes", "gone", "vectors", "hidden")) <= 3
    assert [r.vec for r in store.vecs_for_note(store.get_id("p0")).collect()] == [E.embed_one("again4")]
    store.remove("big")
    store = st.VectorStore.open(spark, store.path, E)
    store.validate()
    store.compact()
    assert store.stats()["parts"] == 1 and store.vectors().count() == 5 and sorted(r.path for r in store.notes().collect()) == ["p0", "q1", "q2", "q3", "q4"]
    first = store.vectors().where("vec_id is not null").orderBy("vec_id").first().vec_id
    assert store.occupied(first) and not store.occupied(10**6)


def test_token_embedder(spark, caplog):
    """Through ids, mask, a model that gives each token a vector, the mean over real tokens, and unit length."""
    import numpy as np

    vocabulary = Vocabulary({b"[UNK]": 100, b"ab": 1, b"##c": 2, b"d": 3})

    def load():
        return lambda ids, mask: np.stack([ids.astype(float), mask * 7.0, np.where(mask == 1, 1.0, 1e9)], axis=2)

    model = TokenEmbedder("tokens", 3, 0.1, 0.5, vocabulary, load, length=6, at_once=2)
    texts = ["abc d", "", None, "zz", "d d d d d d d d", "abc d"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").coalesce(1)
    got = [r.v for r in rows.select("k", model.embed(rows["s"]).alias("v")).orderBy("k").collect()]
    for text, v in zip(texts, got, strict=True):
        if not text:
            assert v is None
            continue
        ids = vocabulary.encode(text.encode())[:6]
        want = np.array([np.mean(ids), 7.0, 1.0])
        assert v == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-6)
    with caplog.at_level("WARNING"):
        assert model.embed_one("abc d") == pytest.approx(got[0]) and not caplog.records
        model.embed_one("abc d!")
    assert len(caplog.records) == 1


@pytest.mark.parametrize("seed", [3])
def test_random_operations(spark, tmp_path, seed):
    lines = []
    run = fuzz.Run(spark, str(tmp_path), seed, E, log=lines.append)
    run.go(10)
    events = [__import__("json").loads(x) for x in lines]
    assert events[0]["event"] == "start" and events[-1] == {"event": "done", "ops": 10} and len({e.get("op") for e in events}) > 3


def test_random_texts():
    rng = random.Random(1)
    texts = [fuzz.random_text(rng, 64) for _ in range(500)]
    assert "" in texts and max(map(len, texts)) > 40 and all(32 <= ord(c) <= 126 for t in texts for c in t) and max(map(len, texts)) <= 64
