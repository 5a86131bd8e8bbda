"""A relevance benchmark of five parts: cases of its own, the search, and the scores, as DataFrames and for SQL.

The parts have as many points as is usual for them: 400 for single words, 400 for similar sentences, 400 for
documents of which one sentence in three fits, 396 for queries of different length and 351 for long
sentences.  Each case has its own few documents; what is scored is which of their paths the search
finds above the embedder's threshold, and which comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import sentences, strip_query, wordlike
from ..functions.vector import dot
from ..operators.embedder import Embedder
from ..operators.search import TIE
from . import relevance as r

#: One of two words is nearer to the query: (first, second, query, path wanted).
WORDS = [
    ("harbour", "meadow", "harbour boats", "a"), ("kitchen", "stadium", "kitchen", "a"), ("copper", "velvet", "velvet curtain", "b"), ("teacher", "farmer", "school", "a"), ("glacier", "volcano", "ice", "a"),
    ("lantern", "anchor", "anchor", "b"), ("orchard", "factory", "fruit", "a"), ("pilot", "baker", "bread", "b"), ("drum", "flute", "drum", "a"), ("spider", "eagle", "eagle nest", "b"),
]
SIMILAR = {
    "1": "Growing tomatoes in a small garden.", "2": "When to water the garden in summer", "3": "Soil and compost for the vegetable garden", "4": "Pruning fruit trees in the garden", "5": "A garden calendar for beginners",
    "6": "Repairing an old bicycle chain", "7": "How to fix a flat bicycle tyre", "8": "Cycling to work in the rain", "9": "The moon has no weather", "10": "Seven cats slept on the stairs", "11": "He never learnt to whistle",
    "12": "Night trains across the mountains", "13": "Cheap train tickets for young travellers", "14": "A slow train along the coast",
}
#: Query, paths that belong to it, paths that don't.
SIMILAR_CASES = [
    ("Looking after a garden", "1 2 3 4 5", "6 7 8 9 10 11 12 13 14"), ("Mending a bicycle", "6 7", "1 2 3 4 5 9 10 11 12 13 14"), ("Travelling by train", "12 13 14", "1 2 3 4 5 6 7 9 10 11"),
]
SPLIT = {
    "tide": "The tide turns twice a day. Nobody rang the bell. Paint dries slowly in winter.", "bees": "My uncle sells hats. The bees return to the hive at dusk. It is late.", "bridge": "Soup was served cold. They walked home. The stone bridge was closed for repairs.",
    "chess": "She opened the chess game with a pawn. The lamp was broken. Rain fell.",
}
SPLIT_CASES = [("turn of the tide", "tide", "bees bridge chess"), ("bees in the hive", "bees", "tide bridge chess"), ("repairs on the stone bridge", "bridge", "tide bees chess"), ("a chess game", "chess", "tide bees bridge")]
LENGTHS = {
    "invoice": "Invoice numbers and payment terms for customers", "backup": "Nightly backup of the file server and its recovery", "printer": "Printer drivers and paper jams in the office", "holiday": "Holiday requests and the sick leave policy", "parking": "Parking permits for visitors and staff",
}
LENGTH_CASES = [
    ("invoice", "invoice"), ("backup", "backup"), ("printer", "printer"), ("payment of an invoice", "invoice"), ("server backup", "backup"), ("printer paper", "printer"),
    ("which payment terms does an invoice for new customers have", "invoice"), ("how do we test the recovery of a backup from the server", "backup"), ("what to do about paper jams in the printer on the second floor", "printer"),
]
LONG = {
    "river_long": "After three weeks of rain the river rose above the old stone quay, flooded the cellars of the market street and carried two moored barges down to the weir before the wardens could close the gates", "river_short": "The river flooded the market street",
    "bread_long": "A loaf of rye bread needs a sour dough that has stood overnight in a warm kitchen, a long slow kneading by hand and an oven that is very hot at first and then cools while the crust hardens", "bread_short": "Rye bread needs a sour dough",
    "stars_long": "On clear nights the observatory opens its dome to visitors, who may look through the large telescope at the moons of the outer planets and at double stars while an astronomer explains what they see", "stars_short": "The telescope shows double stars",
    "other1": "The committee will meet on Thursday", "other2": "Please leave your umbrella at the door",
}
LONG_CASES = [
    ("how the river flooded the market street after the rain", "river_long river_short", "bread_long bread_short stars_long stars_short other1 other2"), ("sour dough for a loaf of rye bread", "bread_long bread_short", "river_long river_short stars_long stars_short other1 other2"),
    ("double stars through the telescope of the observatory", "stars_long stars_short", "river_long river_short bread_long bread_short other1 other2"), ("a warm kitchen and a hot oven", "bread_long", "other1 other2"),
]

BINARY, SENTENCES, PARTS, PARITY, COMPLEX = "single words", "similar sentences", "one sentence in three", "query length", "long sentences"


def cases() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Documents (test, query_id, path, contents), queries (test, query_id, query), expectations (test, query_id, path, include, weight)."""
    docs, queries, expected = [], [], []
    for first, second, query, want in WORDS:
        k = len(queries)
        docs += [(BINARY, k, "a", first), (BINARY, k, "b", second)]
        queries.append((BINARY, k, query))
        expected.append((BINARY, k, want, True, 20))
    for test, texts, own, weight in ((SENTENCES, SIMILAR, SIMILAR_CASES, 10), (PARTS, SPLIT, SPLIT_CASES, 25), (COMPLEX, LONG, LONG_CASES, 13)):
        for query, yes, no in own:
            k = len(queries)
            docs += [(test, k, p, t) for p, t in texts.items()]
            queries.append((test, k, query))
            expected += [(test, k, p, True, weight) for p in yes.split()] + [(test, k, p, False, weight) for p in no.split()]
    for query, want in LENGTH_CASES:
        k = len(queries)
        docs += [(PARITY, k, p, t) for p, t in LENGTHS.items()]
        queries.append((PARITY, k, query))
        expected.append((PARITY, k, want, True, 44))
    return docs, queries, expected


def hits(docs: DataFrame, queries: DataFrame, embed, threshold: float) -> DataFrame:
    """(query_id, rank, path): the paths with a sentence above the threshold among a query's own documents, by their nearest sentence."""
    rows = docs.select("query_id", "path", F.explode(sentences(F.col("contents"))).alias("c")).where(wordlike(F.col("c.contents")))
    held = rows.select("query_id", "path", "c.start_i", embed(F.col("c.contents")).alias("vec"))
    asked = queries.select("query_id", embed(strip_query(F.col("query"))).alias("asked"))
    scored = held.join(asked, "query_id").select("query_id", "path", "start_i", F.round(dot(F.col("vec"), F.col("asked")), TIE).alias("similarity"))
    best = scored.where(F.col("similarity") > threshold).groupBy("query_id", "path").agg(F.max("similarity").alias("similarity"))
    return best.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "path")).alias("rank"), "path")


def run(spark: SparkSession, embedder: Embedder, threshold: float | None = None) -> DataFrame:
    """(label, got, total, percent) for each part and for all."""
    docs, queries, expected = cases()
    d = spark.createDataFrame(docs, "test string, query_id int, path string, contents string")
    q = spark.createDataFrame(queries, "test string, query_id int, query string")
    e = spark.createDataFrame(expected, "test string, query_id int, path string, include boolean, weight int")
    found = hits(d, q, embedder.embed, embedder.threshold if threshold is None else threshold)

    def of(test: str) -> DataFrame:
        return e.where(F.col("test") == test)

    scores = [
        r.binary_scores(found, of(BINARY).select("query_id", F.col("path").alias("want"))).withColumn("label", F.lit(BINARY)),
        *[r.inclusion_scores(found.join(of(t).select("query_id").distinct(), "query_id"), of(t).drop("test")).withColumn("label", F.lit(t)) for t in (SENTENCES, PARTS, COMPLEX)],
        r.first_hit_scores(found, of(PARITY).select("query_id", "path", "weight")).withColumn("label", F.lit(PARITY)),
    ]
    every = scores[0]
    for more in scores[1:]:
        every = every.unionByName(more)
    return r.by_label(every)


def values(rows: list[tuple]) -> str:
    """Rows as SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join(("TRUE" if x else "FALSE") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows) + ")"
