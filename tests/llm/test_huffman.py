import heapq

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from sondera.llm import huffman as h


def best_cost(counts):
    """Bits of an unlimited Huffman code, by the classic heap."""
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def limited_cost(counts, limit):
    """Least bits under a limit, by trying all lengths that fill the code (small cases)."""
    counts = sorted(counts, reverse=True)
    best = None

    def go(k, last, room, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if k == len(counts):
            best = cost
            return
        for n in range(last, limit + 1):
            if room - 2.0**-n >= -1e-12:
                go(k + 1, n, room - 2.0**-n, cost + n * counts[k])

    go(0, 1, 1.0, 0)
    return best


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths_are_optimal_without_a_limit(counts):
    lengths = h.code_lengths(np.array(counts), 24)
    assert sum(2.0**-lengths) == 1
    assert int((lengths * np.array(counts)).sum()) == best_cost(counts)


@settings(max_examples=40, deadline=None)
@given(hs.lists(hs.integers(1, 1000), min_size=3, max_size=7), hs.integers(3, 4))
def test_lengths_are_optimal_under_a_limit(counts, limit):
    lengths = h.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and int((lengths * np.array(counts)).sum()) == limited_cost(counts, limit)


def test_small_alphabets():
    assert h.code_lengths(np.zeros(0, int)).tolist() == [] and h.code_lengths(np.array([5])).tolist() == [1]
    with pytest.raises(ValueError):
        h.code_lengths(np.ones(1 << 25, np.int8))


def test_codes_are_canonical_and_free_of_prefixes():
    book = h.Codebook.of(np.array([9, 3, 7, 1, 5]), np.array([50, 20, 20, 5, 5]))
    codes = [f"{c:0{n}b}" for c, n in zip(book.codes, book.lengths, strict=True)]
    assert codes == sorted(codes, key=lambda c: (len(c), c)) and not any(a != b and b.startswith(a) for a in codes for b in codes)
    again = h.Codebook.canonical(book.ids, book.lengths)
    assert again.codes.tolist() == book.codes.tolist()


def rows(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, token_ids array<int>")


def test_round_trip_and_random_access(spark):
    rng = np.random.default_rng(1)
    lists = [(rng.zipf(1.4, n) % 3000).astype(int).tolist() for n in (0, 1, 511, 512, 513, 5000, 20001)] + [None, [7] * 3000]
    df = rows(spark, lists)
    book = h.codebook(df)
    packed = h.huffman_encode(df, book, block=4096).cache()
    assert all(r.decoded for r in packed.collect())
    back = {}
    for r in sorted(h.huffman_decode(packed, book).collect(), key=lambda r: (r.doc_id, r.block)):
        back.setdefault(r.doc_id, []).append(r.token_ids)
    for k, want in enumerate(lists):
        assert back[k] == [None] if want is None else sum(back[k], []) == want
    one = packed.where("doc_id = 6 and block = 3").first()
    data = np.frombuffer(one["data"], np.uint8)
    got = book.decode(data, np.array([one.checkpoints[2]]), np.array([100]))
    assert got.tolist() == lists[6][3 * 4096 + 1024 : 3 * 4096 + 1124]  # from a checkpoint on, nothing before it
    counts = np.bincount(np.concatenate([x for x in lists if x]))
    share = counts[counts > 0] / counts.sum()
    bits = sum(r.n_bits for r in packed.collect()) / counts.sum()
    assert -(share * np.log2(share)).sum() <= bits <= -(share * np.log2(share)).sum() + 0.1


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, [1, None, 2], "x"), (1, [1, 2], "y"), (1, [1, 2], "y"), (2, [], None)], "doc_id long, token_ids array<int>, data string")
    book = h.codebook(df)
    got = sorted(h.huffman_encode(df, book).collect(), key=str)
    assert [r.n_tokens for r in got] == [2, 2, 0, 2] or sorted(r.n_tokens for r in got) == [0, 2, 2, 2]
    assert all(r.decoded for r in got)
    empty = df.where("false")
    assert h.huffman_encode(empty, h.codebook(empty)).count() == 0
    lone = rows(spark, [[4] * 10])
    assert h.huffman_encode(lone, h.codebook(lone)).first().n_bits == 10


def test_large_ids_and_pieces():
    book = h.Codebook.of(np.array([0, 5_000_000, 2**31 - 1]), np.array([5, 3, 1]))
    lists = pa.array([[0, 5_000_000, 2**31 - 1] * 5, [], [0]], pa.list_(pa.int64()))
    parts = list(h._pack(pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), lists], names=["a", "b"]), book, 4, 2, True, at_once=5))
    assert sum(p.num_rows for p in parts) == 6 and all(x.as_py() for p in parts for x in p.column("decoded"))


def test_an_id_outside_the_code_is_an_error(spark):
    book = h.Codebook.of(np.array([1, 5, 9]), np.array([3, 2, 1]))
    for ids in ([1, 7], [1, 20], [0]):
        with pytest.raises(ValueError, match="isn't in the code"):
            book.encode(np.array(ids), np.array([0, len(ids)]))
    with pytest.raises(ValueError, match="isn't in the code"):
        h.Codebook.of(np.zeros(0, int), np.zeros(0, int)).encode(np.array([1]), np.array([0, 1]))
    with pytest.raises(Exception, match="id 7 isn't in the code"):
        h.huffman_encode(rows(spark, [[1, 7]]), book).collect()
    with pytest.raises(TypeError):
        h.huffman_encode(spark.createDataFrame([("a", [1])], "doc_id string, token_ids array<int>"), book)
