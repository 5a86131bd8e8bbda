import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondera.functions import text as t
from sondera.functions import tokenizer as tk


def reference_scan(data: bytes, delimiters: bytes):
    """A plain scanner of bytes, written for this test."""
    alnum = lambda b: chr(b).isascii() and chr(b).isalnum()
    url = lambda i: data.startswith((b"https://", b"http://"), i)
    out, i = [], 0
    while i < len(data):
        start = i
        if url(i):
            while i < len(data) and data[i] not in b" \n\t":
                i += 1
            kind = "url"
        elif data[i] in delimiters:
            i += 1
            continue
        else:
            while i < len(data) and data[i] not in delimiters and not url(i):
                i += 1
            kind = "string"
        a, b = start, i
        while a < b and not alnum(data[a]):
            a += 1
        while b > a and not alnum(data[b - 1]):
            b -= 1
        if a < b:
            out.append((a, b, data[a:b].decode(), kind))
    return out


def chunks(spark, texts, delimiters):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, s string")
    rows = df.select("k", t.spans(F.col("s"), delimiters).alias("c"), t.chunks(F.col("s"), delimiters).alias("plain")).orderBy("k").collect()
    for r in rows:
        assert [c.contents for c in r.c] == list(r.plain)
        assert [c.pos for c in r.c] == list(range(len(r.c)))
    return [[(c.start_i, c.end_i, c.contents, c.type) for c in r.c] for r in rows]


CASES = ["", " ", "pizza. pizza. pizza.", " foo       bar\t\t. baz .", "((((--foo--))))!?", "skip.******.garbage.", "see https://a.b/c?d=e. and more. http://x.y/ end", "midhttps://u.v w", "https://", "http:/ /x", "é à. ünï", "a\r\nb. c", "漢字 abc. 漢", "😀 ok 😀. 😀", "x" * 5000 + ". " + "y z" * 2000, "hhttp://h.http https://"]


@pytest.mark.parametrize("delimiters", [t.SENTENCE, t.WORD])
def test_splitter_against_a_byte_scanner(spark, delimiters):
    rng = random.Random(4)
    texts = CASES + ["".join(rng.choice(["a", "b1", ".", "!", "\n", " ", ",", "é", "http://", "https://q", "\t", "h", "-", "漢"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    assert chunks(spark, texts, delimiters) == [reference_scan(x.encode(), delimiters.encode()) for x in texts]


def test_offsets(spark):
    assert [c[:2] for c in chunks(spark, ["pizza. pizza. pizza."], t.SENTENCE)[0]] == [(0, 5), (7, 12), (14, 19)]


def test_null_text(spark):
    df = spark.createDataFrame([(None,), ("a b",)], "s string")
    assert [r[0] if r[0] is None else len(r[0]) for r in df.select(t.words(F.col("s"))).collect()] == [None, 2]


def test_predicates(spark):
    rows = [("", True, False, ""), (" \n\r\t ", True, False, ""), ("a#", False, False, "a"), ("a-b", False, True, "a-b"), ("a", False, False, ""), ("?a", False, False, ""), ("a?", False, False, "a"), ("??", False, False, ""), (" é ab! ", False, True, "ab"), ("(ab)", False, True, "ab")]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = df.select("s", t.whitespace_only(F.col("s")), t.wordlike(F.col("s")), t.strip_query(F.col("s"))).collect()
    assert {tuple(r) for r in got} == set(rows)
    assert all(t.strip_query_text(r[0]) == r[3] for r in rows)
    assert df.select(t.ascii_lower(F.lit("AÉz"))).first()[0] == "aÉz"


TINY = '{"model": {"vocab": {"hello": 7592, "world": 2088, "[CLS]": 101, "[SEP]": 102, "[UNK]": 100, "un": 5, "##do": 6}}}'


def test_wordpiece(spark):
    vocabulary = tk.Vocabulary.parse(TINY)
    df = spark.createDataFrame([("hello world",), ("Hello undo, é",), ("x" * 101,), ("",), (None,)], "s string")
    rows = df.select(tk.wordpiece(F.col("s"), vocabulary).alias("i")).select("i", tk.padded(F.col("i"), 6).alias("p")).collect()
    assert [r.i for r in rows] == [[101, 7592, 2088, 102], [101, 7592, 5, 6, 100, 100, 100, 102], [101, 100, 102], [101, 102], None]
    assert rows[0].p.ids == [101, 7592, 2088, 102, 0, 0] and rows[0].p.mask == [1, 1, 1, 1, 0, 0]
    assert rows[1].p.ids == [101, 7592, 5, 6, 100, 100] and rows[4].p is None
    assert df.select(tk.basic_tokens(F.col("s"))).collect()[1][0] == ["hello", "undo", ",", "é", "é"]


def test_special_ids():
    v = tk.Vocabulary.parse('{"model": {"vocab": {"a": 1}}, "post_processor": {"cls": ["[C]", 8], "sep": ["[S]", 9]}}')
    assert (v.cls, v.sep, v.unknown) == (8, 9, 100)


@pytest.mark.parametrize("delimiters", [t.SENTENCE, t.WORD])
def test_span_rows_in_slices(spark, monkeypatch, delimiters):
    """As one scan of each text, also over slices and batches, with nulls, URLs and texts without a letter."""
    texts = ["a bc. http://x.y/z?q=1 httpx. é", None, "", "...", "x", "ab é. ç!\n(d) https://a.b, c", "é" * 9, "http", *(f"w{k}, {k}. ok" for k in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string").repartition(3)
    want = {(k, n, a, b, x.encode()[a:b].decode(), "url" if url else "string") for k, x in enumerate(texts) if x for n, (a, b, url) in enumerate(t.scan(x.encode(), delimiters))}
    got = [tuple(r) for r in t.span_rows(df, F.col("s"), "k", delimiters=delimiters).collect()]
    assert len(got) == len(want) and set(got) == want
    least = t.span_rows(df, F.col("s"), "k", delimiters=delimiters, least=2, drop=("pos", "type")).collect()
    assert {tuple(r) for r in least} == {(k, a, b, c) for k, _, a, b, c, _ in want if sum(x.isascii() and x.isalnum() for x in c) >= 2}
    for most in (1, 10, 10**6):
        column = pa.array(texts)
        cut = list(t.slices(column, most))
        assert [k for a, b in cut for k in range(a, b)] == list(range(len(texts)))
        assert all(b == a + 1 or sum(len((x or "").encode()) for x in texts[a:b]) <= most for a, b in cut)


@pytest.mark.parametrize("kept", [None, {}])
def test_first_ids_of_a_long_text(kept):
    """The first ids are those of the whole text, and no more of it is tokenized than they need."""
    v = tk.Vocabulary({b"a": 1, b"b": 2, b"##b": 3, b".": 4, b"[UNK]": 100})
    text = b"ab A b. c ab \xc3\xa9 ." * 3
    for most in range(40):
        assert v.encode(text, most, kept) == v.encode(text)[:most]
    seen = []
    v.pieces = lambda w: seen.append(w) or [7]
    assert v.encode(b"a " * 100_000, 128) == [101] + [7] * 127 and len(seen) == 127


def test_hashed_columns(monkeypatch):
    """The vectors of a column, from its buffer, are those of its texts one by one, and MD5 is asked once for each distinct word."""
    from sondera.operators import embedder as e

    texts = ["The the THE", None, "", "ab", "ab cd", "é", "a é b. C-d9", "...", "x" * 50, "ab"] * 3
    asked = []
    real = e.hashlib.md5
    monkeypatch.setattr(e.hashlib, "md5", lambda w: asked.append(w) or real(w))
    for some in (texts, texts[:1], ["", None], [], texts[2:9]):
        for column in (pa.array(some, pa.string()), pa.array(["zz", *some], pa.string()).slice(1)):
            asked.clear()
            got = e.hash_column(column, 8, {})
            assert len(asked) == len(set(asked))
            want = e.hash_vectors(some, 8, {})
            assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
