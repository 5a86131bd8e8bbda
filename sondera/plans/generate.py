"""Seeded inputs for tests and benchmarks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import normalize

STEMS = "amber basil cedar delta ember fjord grove haven inlet jolly kayak lemon maple north olive pearl quilt river stone tulip umber vivid water xenon yield zebra".split()
ENDS = ["", "s", "ed", "ing", "ward", "like"]
LEXICON = [a + b for a in STEMS for b in ENDS]


def generate_note(rng: random.Random) -> str:
    """5 to 10 sentences of 5 to 8 words, ended by . ! ? in turn."""
    return " ".join(" ".join(rng.choice(LEXICON) for _ in range(rng.randint(5, 8))).capitalize() + ".!?"[k % 3] for k in range(rng.randint(5, 10)))


def generate_notes(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    rng = random.Random(seed)
    return spark.createDataFrame([(f"note-{k:06d}", generate_note(rng)) for k in range(n)], "path string, contents string")


def random_unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 99) -> DataFrame:
    """(vec_id, vec): uniform in [-1, 1] by component, then of unit length; made where the rows are."""
    component = lambda i: (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1).cast("float")
    return spark.range(n).select(F.col("id").alias("vec_id"), normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component)).alias("vec"))
