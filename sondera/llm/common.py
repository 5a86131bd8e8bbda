"""What the operators of this subpackage share: names, the shared folder, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def place(df: DataFrame, name: str) -> int:
    """Where the column of that very name is; without one, the column whose name differs in case only."""
    found = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{'more than one' if found else 'no'} column {name} in {df.columns}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ...: names that clash, in case too, are no trouble then."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The columns of the given names under those of the keywords."""
    return by_place(df).select(*[F.col(f"c{place(df, name)}").alias(new) for new, name in columns.items()])


def whole(df: DataFrame, name: str) -> int:
    """``place`` of a column of ids, which must be integers: others are refused before anything runs."""
    at = place(df, name)
    kind = df.schema.fields[at].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"column {name} must have integers, not {kind.simpleString()}")
    return at


def rows_of(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """``picked`` with the ids, as ``id``, in 64 bits before the other columns."""
    whole(df, id_col)
    return picked(df, id=id_col, **columns).withColumn("id", F.col("id").cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; one of our own only where that is unset and all is on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sondera-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it from there: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sondera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_sondera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows whose key has the least hash: the same rows in any layout of the table."""
    return df.orderBy(F.xxhash64(key), key).limit(most)
