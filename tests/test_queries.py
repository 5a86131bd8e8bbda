"""Every query with SQL against DuckDB on the smallest tables."""

import hashlib
import os
import warnings

import duckdb
import pytest

import __spark_entry__ as entry
from sondera.plans import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = query(spark, DATA)
    found = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    compare(spark, q.queries()[name], q.oracle_sql()[name])


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_entry_and_registry(spark):
    assert set(q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["rank", "path", "start_i", "end_i", "similarity"]
    assert q.wordpiece_tokenize(spark, DATA).count() > 0


@pytest.mark.parametrize("error", [SyntaxError("broken"), ModuleNotFoundError("No module named 'numpy.gone'", name="numpy.gone"), ModuleNotFoundError("No module named 'sondera.llm'", name="sondera.llm")])
def test_what_cannot_be_imported_is_left_out(monkeypatch, error):
    real = entry.importlib.import_module

    def fails(name):
        if name.startswith("sondera.llm"):
            raise error
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", fails)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert set(entry.queries()) == set(q.queries()) and set(entry.oracle_sql()) == set(q.oracle_sql())
    assert bool(told) == (getattr(error, "name", None) != "sondera.llm")  # one that was deleted is no news


def test_highlights_of_mixed_words(spark, tmp_path):
    """Words of several runs, of which most or all that don't cancel hash like "the": as by the SQL."""
    texts = ["the ch\u00e4ch\u00fcch\u00f6foo ch\u00e4ch\u00fc The", "the-the-the-foo the-the; the-foo (the)", "the\u00e9the the the the the", "x \u00e9 !"]
    # runs whose components cancel
    code = lambda w: divmod(int(hashlib.md5(w.encode()).hexdigest()[:9], 16), 16)
    seen = {}
    for w in (f"w{k}" for k in range(2000)):
        bucket, sign = code(w)[0] % q.DIM, code(w)[1] % 2
        if (bucket, 1 - sign) in seen:
            texts.append(f"the-{w}-{seen[bucket, 1 - sign]} the")
            break
        seen[bucket, sign] = w
    spark.createDataFrame([(k, 0, x) for k, x in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(q.oracle_sql()["highlights"]).fetchall())
    assert sorted(tuple(r) for r in q.highlights(spark, str(tmp_path)).collect()) == want and len(want) == 10


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_quality_score_searches_once(spark):
    """Its three scores read what one search has written, of which each product counts for both vectors."""
    plan = q.quality_score(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "/shown-" in plan
