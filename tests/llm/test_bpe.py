import os
import random

import numpy as np
import pyarrow as pa
import pytest

from sondera.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.RANK_FILE), reason="no rank file")
ALPHABET = "abZ01 \n\t\r'sdtlverm éß 　 \x85漢😀!.,  _"


def texts():
    rng = random.Random(3)
    return ["", " ", "  x  ", "don't I'll we've", "a\n\n b", "é" * 50, "  x", "x　 y"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(3000)]


@pytest.mark.parametrize("long", [bpe.LONG, 5])
def test_ids_are_those_of_the_whole_text(monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    t, own = bpe.tokenizer(), texts()
    tokens, ends = t.encode(pa.array(own))
    for k, text in enumerate(own):
        assert tokens[ends[k] : ends[k + 1]].tolist() == t.encoding.encode_ordinary(text), repr(text)
    body, offsets = bpe.raw(pa.array(own))
    back, cut = t.decode(tokens, ends)
    assert np.array_equal(back, body) and np.array_equal(cut, offsets)


def test_pieces_do_not_matter(monkeypatch):
    t, own = bpe.tokenizer(), texts()
    want = t.encode(pa.array(own))
    monkeypatch.setattr(bpe, "PIECE", 50)
    got = t.encode(pa.array(own))
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def test_very_long_texts(spark):
    rows = [(1, "word " * 300_000), (2, "a" * 200_000), (3, "ab1" * 100_000), (4, " " * 100_000)]
    got = {r.doc_id: r for r in bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t = bpe.tokenizer()
    for k, text in rows:
        assert got[k].round_trip and got[k].n_tokens == len(got[k].token_ids)
        assert got[k].token_ids == t.encoding.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (None, "x", 8), (1, "hello world", 7), (4, None, 9), (5, "", 10)], "doc_id long, text string, token_ids int")
    out = bpe.bpe_encode(df)
    got = sorted(out.collect(), key=str)
    assert [(r.doc_id, r.n_tokens) for r in got] == sorted([(1, 2), (1, 2), (None, 1), (4, None), (5, 0)], key=lambda x: str(x).replace("(", "Row(doc_id=").replace(", ", ", n_tokens="))
    back = {(r.doc_id, r.text) for r in bpe.bpe_text(out).collect()}
    assert back == {(1, "hello world"), (None, "x"), (4, None), (5, "")}
    assert bpe.bpe_encode(df.where("false")).count() == 0
    unknown = spark.createDataFrame([(1, [15339, 999_999, None])], "doc_id long, token_ids array<int>")
    assert bytes(bpe.bpe_decode(unknown).first()["bytes"]) == bpe.tokenizer().bytes[15339]


def test_invalid_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF20C3') AS STRING) AS text")
    row = bpe.bpe_encode(df).first()
    assert row.round_trip is False and bytes(bpe.bpe_decode(bpe.bpe_encode(df)).first()["bytes"]).decode() == "a� �"


def test_a_token_within_a_character(spark):
    t = bpe.tokenizer()
    ids, ends = t.encode(pa.array(["漢"]))
    if len(ids) > 1:
        df = spark.createDataFrame([(1, [int(ids[0])])], "doc_id long, token_ids array<int>")
        assert bytes(bpe.bpe_decode(df).first()["bytes"]) == "漢".encode()[: t.lengths[ids[0]]]
