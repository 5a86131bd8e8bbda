import hashlib
import itertools

import numpy as np
import pytest

from sondera.llm import mixing as mx

SCHEMA = "doc_id long, text string, lang string, source string, margin_source string"


def corpus(n=3000):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        words = int(rng.integers(1, 400))
        rows.append((k, " ".join(["wörd"] * words), ["en", "en", "de", "fr"][int(rng.integers(0, 4))], f"s{min(int(rng.integers(0, 12)), 5)}", "x"))
    return rows


def topic(text):
    for mark, name in (("License", "licensed"), ("@", "contacts"), (" | ", "tabular")):
        if mark in text:
            return name
    return "longform" if len(text) >= 4000 else "article" if len(text) >= 1000 else "note"


def by_brute_force(rows, alpha=mx.ALPHA, sweeps=mx.SWEEPS):
    """Document by document, with no table of cells."""
    levels = [(s or "", lang or "", topic(t) if t is not None else "") for _, t, lang, s, _ in rows]
    mass = np.array([t.count(" ") + 1 if t else 0 for _, t, *_ in rows], float)
    weight = np.ones(len(rows))
    for _ in range(sweeps):
        for m in range(3):
            own = np.array([x[m] for x in levels])
            have = {v: mass[own == v].sum() for v in set(own)}
            share = {v: (have[v] / mass.sum()) ** alpha for v in have if have[v]}
            for v in share:
                now = (mass * weight)[own == v].sum()
                weight[own == v] *= share[v] / sum(share.values()) * mass.sum() / now
    live = {x for x, n in zip(levels, mass, strict=True) if n}
    most = max(weight[k] for k, x in enumerate(levels) if x in live)
    out = {}
    for (i, *_), w, n in zip(rows, weight, mass, strict=True):
        if i is not None and int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52 < min(1, w / most):
            out.setdefault(i, []).append((int(n), round(w, 5)))
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.tokens, round(r.weight, 5)))
    return out


def test_against_brute_force(spark):
    rows = corpus(800)
    got, want = collected(mx.mix(spark.createDataFrame(rows, SCHEMA))), by_brute_force(rows)
    assert got.keys() == want.keys()
    for k in got:
        assert [n for n, _ in got[k]] == [n for n, _ in want[k]] and got[k][0][1] == pytest.approx(want[k][0][1], abs=2e-5)


def test_margins_meet_their_targets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"lang": {"en": 0.5, "de": 0.25, "fr": 0.25}, "source": {f"s{k}": 1 / 6 for k in range(6)}}
    out = mx.weighted(df, "doc_id", "text", "source", "lang", None, targets, 1.0, 60, None)
    seen = out.selectExpr("c2 AS lang", "c3 AS source", "tokens", "weight").toPandas()
    mass = seen.tokens * seen.weight
    for level, share in targets["lang"].items():
        assert mass[seen.lang == level].sum() / mass.sum() == pytest.approx(share, abs=1e-3)
    for level, share in targets["source"].items():
        assert mass[seen.source == level].sum() / mass.sum() == pytest.approx(share, abs=1e-3)
    picked = mx.mix(df, targets=targets, alpha=1.0, sweeps=60).join(df, "doc_id").toPandas()
    for level, share in targets["lang"].items():  # what was drawn is near what is expected
        assert picked.tokens[picked.lang == level].sum() / picked.tokens.sum() == pytest.approx(share, abs=0.06)


def test_budget(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(t.count(" ") + 1 for _, t, *_ in rows)
    for share in (0.1, 0.5, 0.9):
        seen = mx.weighted(df, "doc_id", "text", "source", "lang", None, None, mx.ALPHA, mx.SWEEPS, share).select("tokens", "probability").toPandas()
        assert (seen.tokens * seen.probability).sum() == pytest.approx(share * total, rel=1e-6) and seen.probability.max() <= 1
        assert mx.mix(df, budget_share=share).toPandas().tokens.sum() == pytest.approx(share * total, rel=0.25)


def test_rake_against_many_small_steps():
    codes = np.array(list(itertools.product(range(3), range(2))))
    mass = np.array([5.0, 1, 2, 8, 3, 4])
    targets = [np.array([10.0, 8, 5]), np.array([9.0, 14])]
    f = mx.rake(codes, mass, targets, 200)
    weight = mass * f[0][codes[:, 0]] * f[1][codes[:, 1]]
    assert np.bincount(codes[:, 0], weight) == pytest.approx(targets[0]) and np.bincount(codes[:, 1], weight) == pytest.approx(targets[1])


def test_odd_rows(spark):
    rows = corpus(200) + [(None, "a b", "en", "s0", "x"), (5, None, None, None, None), (6, "", "en", None, "x"), (7, "a b c", "en", "s1", "x"), (7, "a b c", "en", "s1", "x"), (9001, "z " * 200_000, "en", "s1", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = collected(mx.mix(df)), by_brute_force(rows)
    assert {k: sorted(v) for k, v in got.items()}.keys() == want.keys() and None not in got
    kept = mx.mix_rows(df)
    assert kept.columns == df.columns and kept.count() == sum(map(len, got.values()))
    assert mx.mix(df.where("false")).count() == 0 and mx.mix_rows(df.where("false")).count() == 0
    assert mx.mix(df.where("text = ''")).count() in (0, 1)  # no tokens at all
