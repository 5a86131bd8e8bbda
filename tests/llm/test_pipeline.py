import math
import os
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from sondera.llm import bpe, common, minhash, queries, toxicity
from sondera.llm.textvec import token_hashes
from tests.llm.test_minhash import groups_by_brute_force
from tests.llm.test_mixing import by_brute_force as mixing_by_brute_force
from tests.test_queries import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.exists(DATA) or not os.path.exists(bpe.RANK_FILE), reason="no test tables or no rank file")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_registry():
    found = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)) and found["pipeline"] is pipeline.run


def toxic_by_hand(model, text):
    """The features of a text one token at a time, and the sum of their weights."""
    found = set()
    for word in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text):
        for _, _, whole, _, heads in token_hashes(pa.array([word]), prefixes=toxicity.PREFIXES):
            found |= {int(x) >> 32 for h in (whole, *heads) for x in h}
    at = {int(f): k for k, f in enumerate(model.features)}
    own = [at[f] for f in found if f in at]
    return bool(own) and 1 / (1 + math.exp(-(model.bias + sum(model.weights[own])))) > 0.5


def test_stages_by_brute_force(spark):
    """Every stage on what its predecessor kept: it only takes rows away, and exactly those that it should."""
    docs = common.table(spark, DATA, "documents")
    names, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for step, stage in pipeline.STAGES[:-1]:
        before = docs
        out = stage(spark, docs, DATA)
        assert out.columns == names
        docs = common.written(out, step)
        kept = {r.doc_id: r for r in docs.collect()}
        assert kept and all(rows[k] == r for k, r in kept.items())
        gone = [k for k in rows if k not in kept]
        if step == "toxicity":
            model = toxicity.train(before, common.table(spark, DATA, "labels"))
            assert sorted(gone) == sorted(k for k, r in rows.items() if toxic_by_hand(model, r.text)) and gone
        elif step == "exact_dedup":
            texts = {}
            for k, r in rows.items():
                texts.setdefault(r.text, []).append(k)
            assert sorted(kept) == sorted(min(v) for v in texts.values())
        elif step == "near_dedup":
            group, pairs = groups_by_brute_force([(k, r.text) for k, r in rows.items()], minhash.THRESHOLD)
            assert all(min(m for m in group if group[m] == group[k]) in kept for k in gone)  # the first of its group stayed
            lost = [k for k in kept if group[k] != k]  # near another, but met in no band
            assert len(lost) <= 0.05 * sum(group[k] != k for k in group) and all(group[k] != k for k in gone)
            assert sum(a in kept and b in kept for a, b in pairs) <= 0.05 * len(pairs)
        else:
            want = mixing_by_brute_force([(r.doc_id, r.text, r.lang, r.source, None) for r in rows.values()])
            assert sorted(kept) == sorted(want)
        rows = kept
    last = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    t = bpe.tokenizer()
    assert sorted(r.doc_id for r in last) == sorted(rows)
    assert all(r.round_trip and r.token_ids == t.encoding.encode_ordinary(rows[r.doc_id].text) and r.n_tokens == len(r.token_ids) for r in last)


def test_stages_with_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as those that operators make."""
    extra = ["id", "key", "size", "head", "c0", "tokens", "probability", "toxicity", "Text"]
    docs = common.table(spark, DATA, "documents").limit(60)
    odd = [(None, "a text without an id", "en", "s", 1), (9001, None, None, None, None), (9002, "", None, None, None), (9003, "", "en", "s", 0), (9004, "long " * 200_000, "en", "s", 9), (9005, "twice the same", "en", "s", 1), (9005, "twice the same", "en", "s", 1), (9006, "…", "en", "s", 1)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    for name in extra:
        docs = docs.withColumns({name: F.lit("x")}) if name.lower() not in [c.lower() for c in docs.columns] else docs.toDF(*docs.columns).select("*", F.lit("x").alias(name))
    docs = docs.cache()
    names = docs.columns
    expected = {"toxicity": {None: 1, 9001: 1, 9002: 1, 9003: 1, 9004: 1, 9005: 2, 9006: 1}, "exact_dedup": {None: 1, 9001: 1, 9002: 1, 9004: 1, 9005: 1, 9006: 1}, "near_dedup": {None: 1, 9001: 1, 9002: 1, 9003: 1, 9004: 1, 9005: 2, 9006: 1}}
    for step, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == names
        found = Counter(r[0] for r in out.select(F.col("doc_id")).collect())
        if step in expected:
            assert {k: n for k, n in found.items() if k is None or k > 9000} == expected[step], step
        else:
            assert None not in found and found[9005] in (0, 2)
        empty = stage(spark, docs.where("false"), DATA)
        assert empty.columns == names and empty.count() == 0
    last = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    assert last[9001].token_ids is None and last[9002].token_ids == [] and last[9004].round_trip and None in last


def test_run_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        common.table(spark, DATA, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and out.where("not round_trip").count() == 0
