import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from sondera.llm import minhash as mh
from sondera.llm import textvec as tv


def hashes(text, classes=tv.WORDS, **more):
    parts = [h for _, _, h, _, _ in tv.token_hashes(pa.array([text], pa.large_string()), classes, **more)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def single(c):
    return any(lo <= ord(c) <= hi for lo, hi in tv._SINGLE) or 0x20000 <= ord(c) < 0x40000


def tokens(text, punctuation=False):
    """The rule of ``textvec``, character by character."""
    out, run, kind = [], "", ""
    for c in text:
        what = unicodedata.category(c)[0]
        now = "" if what == "Z" or c in "\u200b\u2060\ufeff" or ord(c) < 33 or 0x7F < ord(c) < 0xA0 else ("p" if punctuation else "") if what in "PS" or c == "\x7f" else "s" if single(c) else "w"
        if run and (now != kind or now == "s"):
            out.append(run)
            run = ""
        if now:
            run += c
        kind = now
    return out + [run] * bool(run)


TEXTS = ["plain words, and more.", "“quoted” — «text»… naïve façade", "你好,世界。我们在一起!", "ภาษาไทยไม่มีช่องว่าง", "日本語のテキスト、カタカナも。", "mixed 中文 and English中", "emoji 😀😀 here", "a\u00a0b\u3000c", "한국어는 띄어쓰기를 한다", "x\u200by", ""]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens(text):
    for classes, punctuation in ((tv.WORDS, False), (tv.RUNS, True)):
        want = tokens(text, punctuation)
        got = hashes(text, classes, fold=False)
        assert len(got) == len(want), want
        assert [int(x) for x in got] == [int(hashes(w, classes, fold=False)[0]) for w in want]


def test_long_tokens_do_not_repeat_their_weights():
    rng = random.Random(3)
    a, b, c = ("".join(rng.choice("abcdef") for _ in range(4096)) for _ in range(3))
    seen = {int(hashes(x)[0]) for x in (a + b, b + a, a + b + c, b + a + c, c + a + b, a + c + b)}
    assert len(seen) == 6 and all(len(hashes(x)) == 1 for x in (a + b, a + b + c))


def test_pieces_of_a_long_text(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "中", "。", "ไทย", "é", "longer-word "]) for _ in range(4000))
    whole = hashes(text)
    monkeypatch.setattr(tv, "CHUNK", 501)
    assert np.array_equal(hashes(text), whole) and len(whole) == len(tokens(text))


@pytest.mark.parametrize("alphabet", ["的一是不了人我在有他这中大来上个国到说们", "กขคงจชซญดตถทนบปผพฟมยรลวสหอ"])
def test_near_duplicates_in_scripts_without_spaces(spark, alphabet):
    rng = random.Random(6)
    rows, near = [], {}
    for k in range(12):
        base = [rng.choice(alphabet) for _ in range(400)]
        rows.append((2 * k, "".join(base)))
        if k % 2:
            edited = [rng.choice(alphabet) if rng.random() < 0.04 else c for c in base]
            rows.append((2 * k + 1, "、".join("".join(edited[j : j + 50]) for j in range(0, 400, 50))))

    def shingles(text):
        t = [c for c in text if c != "、"]
        return {tuple(t[j : j + 3]) for j in range(len(t) - 2)}

    for a, ta in rows:
        for b, tb in rows:
            if a < b and len(shingles(ta) & shingles(tb)) / len(shingles(ta) | shingles(tb)) >= mh.THRESHOLD:
                near[b] = a
    assert len(near) == 6
    got = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.dup_of for r in got} == near
    assert re.search(r"\w", rows[0][1])
