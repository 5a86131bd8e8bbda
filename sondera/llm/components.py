"""Connected components of a table of edges, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``edges`` (a, b long); ``comp`` is the least id of its component.

    Each round every id takes the least label among itself and its neighbours and then the label
    of that label, so that the rounds grow with the logarithm of a chain's length; each round is
    a table in the shared folder.  An edge with a null or from an id to itself adds nothing.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(both.unionAll(both.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        stepped = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "comp", F.least("comp", "least").alias("new"))
        jumped = stepped.join(labels.select(F.col("id").alias("new"), F.col("comp").alias("root")), "new", "left")
        comp = F.coalesce("root", "new")
        new = written(jumped.select("id", comp.alias("comp"), (comp != F.col("comp")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("id", "comp")
