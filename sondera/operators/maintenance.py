"""Changes to the tables notes (note_id, path) and vectors (vec_id, note_id, start_i, end_i, vec) as new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import written


def numbered(df: DataFrame, order: list[str], first: int, name: str, used: list[DataFrame] | None = None) -> DataFrame:
    """``df`` with successive numbers from ``first`` on, in that order, without bringing all rows into one partition.

    Rows are range-partitioned by the order; a number is the row's place in its partition and the
    sizes of the partitions before, which are the only thing that is gathered.  Who is where is settled by a
    table in the shared folder, which is added to ``used`` for the caller to discard.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    if used is not None:
        used.append(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*order))).join(before, "_part")
    return placed.withColumn(name, F.lit(first - 1).cast("long") + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def new_ids(keys: DataFrame, key: str, first: int, name: str, used: list[DataFrame] | None = None) -> DataFrame:
    """Distinct keys with ids from ``first`` on, by the order of the keys."""
    return numbered(keys.select(key).distinct(), [key], first, name, used)


def unknown(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths that the manifest hasn't got."""
    return paths.select("path").distinct().join(notes, "path", "left_anti")


def get_or_create_ids(notes: DataFrame, paths: DataFrame, next_id: int) -> DataFrame:
    """The manifest with the paths that it hadn't: known paths keep their ids, new ones get the next, by the order of their names."""
    return notes.unionByName(new_ids(unknown(notes, paths), "path", next_id, "note_id").select("note_id", "path"))


def remove_by_note(vectors: DataFrame, note_ids: DataFrame) -> DataFrame:
    return vectors.join(note_ids, "note_id", "left_anti")


def replace_vectors(vectors: DataFrame, new: DataFrame, note_ids: DataFrame) -> DataFrame:
    """All vectors of the notes in ``note_ids`` give way to those in ``new``."""
    return remove_by_note(vectors, note_ids).unionByName(new)


def copy_vector(vectors: DataFrame, vec_id: int, new_id: int) -> DataFrame:
    """With a second row like ``vec_id`` under ``new_id``; an unknown id adds nothing."""
    return vectors.unionByName(vectors.where(F.col("vec_id") == vec_id).withColumn("vec_id", F.lit(new_id).cast("long")))


def remove_vector(vectors: DataFrame, vec_id: int) -> DataFrame:
    return vectors.where(F.col("vec_id") != vec_id)


def vecs_for_note(vectors: DataFrame, note_id: int) -> DataFrame:
    return vectors.where(F.col("note_id") == note_id).orderBy("start_i", "vec_id")


def renamed(notes: DataFrame, old: str, new: str) -> DataFrame:
    return notes.withColumn("path", F.when(F.col("path") == old, F.lit(new)).otherwise(F.col("path")))


def prune(notes: DataFrame, existing: DataFrame) -> DataFrame:
    """The notes whose path exists."""
    return notes.join(existing.select("path").distinct(), "path", "left_semi").select("note_id", "path")


def overlaps(vectors: DataFrame, width: int = 1024) -> DataFrame:
    """(note_id, vec_a, vec_b) of vectors of one note with ``a.start < b.end and b.start < a.end``.

    Intervals meet in the stretches of ``width`` bytes that they touch, so that a note of very many
    vectors is neither one task's nor compared pair by pair; a pair counts in the stretch of its later start.
    """
    last = F.greatest("start_i", F.col("end_i") - 1)
    stretches = F.explode(F.sequence(F.floor(F.col("start_i") / width), F.floor(last / width)))
    rows = vectors.select("note_id", "vec_id", "start_i", "end_i", stretches.alias("stretch"))
    a = rows.select("note_id", "stretch", F.col("vec_id").alias("vec_a"), F.col("start_i").alias("a_start"), F.col("end_i").alias("a_end"))
    b = rows.select("note_id", "stretch", F.col("vec_id").alias("vec_b"), F.col("start_i").alias("b_start"), F.col("end_i").alias("b_end"))
    met = a.join(b, ["note_id", "stretch"]).where("vec_a < vec_b and a_start < b_end and b_start < a_end")
    return met.where(F.col("stretch") == F.floor(F.greatest("a_start", "b_start") / width)).select("note_id", "vec_a", "vec_b")


def latest(docs: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """The row of the highest ``seq`` for each key; of equal ones the greatest contents."""
    others = [c for c in docs.columns if c not in (key, seq)]
    best = docs.groupBy(key).agg(F.max(F.struct(seq, *others)).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in (seq, *others)])
