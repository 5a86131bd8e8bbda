"""Scores of a relevance benchmark, from a table of results (query_id, rank, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binary_scores(results: DataFrame, wanted: DataFrame, points: int = 20) -> DataFrame:
    """(query_id, got, total): ``points`` if the wanted path (query_id, want) ranks first, and as many again if it is the only hit."""
    hits = results.groupBy("query_id").agg(F.min_by("path", "rank").alias("first"), F.count("*").alias("n"))
    best = wanted.join(hits, "query_id", "left")
    right = F.coalesce(F.col("first") == F.col("want"), F.lit(False))
    return best.select("query_id", (F.when(right, points).otherwise(0) + F.when(right & (F.col("n") == 1), points).otherwise(0)).alias("got"), F.lit(2 * points).alias("total"))


def inclusion_scores(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, got, total) for (query_id, path, include, weight): the weight of each path that is there, or not there, as expected."""
    seen = results.select("query_id", "path").distinct().withColumn("hit", F.lit(True))
    judged = expected.join(seen, ["query_id", "path"], "left").withColumn("right", F.coalesce("hit", F.lit(False)) == F.col("include"))
    return judged.groupBy("query_id").agg(F.sum(F.when(F.col("right"), F.col("weight")).otherwise(0)).alias("got"), F.sum("weight").alias("total"))


def first_hit_scores(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, got, total) for (query_id, path, weight): the weight if that path ranks first."""
    first = results.where("rank = 1").select("query_id", F.col("path").alias("first"))
    judged = expected.join(first, "query_id", "left")
    return judged.select("query_id", F.when(F.col("first") == F.col("path"), F.col("weight")).otherwise(0).alias("got"), F.col("weight").alias("total"))


def report(scores: DataFrame, label: str) -> DataFrame:
    """(label, got, total, percent)."""
    sums = scores.agg(F.coalesce(F.sum("got"), F.lit(0)).alias("got"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return sums.select(F.lit(label).alias("label"), "got", "total", F.round(F.when(F.col("total") > 0, 100.0 * F.col("got") / F.col("total")).otherwise(0.0), 2).alias("percent"))


def by_label(scores: DataFrame) -> DataFrame:
    """(label, got, total, percent) for each ``label`` of the scores, and for "all"."""
    sums = scores.groupBy(F.col("label")).agg(F.sum("got").alias("got"), F.sum("total").alias("total"))
    every = scores.agg(F.lit("all").alias("label"), F.sum("got").alias("got"), F.sum("total").alias("total"))
    return sums.unionByName(every).withColumn("percent", F.round(F.when(F.col("total") > 0, 100.0 * F.col("got") / F.col("total")).otherwise(0.0), 2))
