"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with
the columns of ``docs`` but for the last; columns beside those of documents travel along, whatever their
names.  ``run`` applies them to the table documents of a folder.  Every stage takes whole texts, however
long, and gives an empty result for an empty table; ids must be integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondera.llm.bpe import bpe_encode
from sondera.llm.common import table, written
from sondera.llm.exact_dedup import exact_dedup
from sondera.llm.minhash import drop_near_duplicates
from sondera.llm.mixing import mix_rows
from sondera.llm.toxicity import drop_toxic
from sondera.sources.shared import spread


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by itself: null and empty texts stay, a null id changes nothing, repeated rows stay or go together.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of byte-equal texts stays, that of the least id.

    All rows with a null text stay; one of those with an empty text; a null id comes last; of a repeated row one stays.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id.

    Rows with a null id, or a null, empty or tokenless text, are in no group and stay; repeated rows stay or go together.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose expected tokens have the target shares of source, language and topic.

    A null source, language or topic is a level of its own; a null or empty text has no tokens and is drawn by
    its levels; a row with a null id goes; repeated rows stay or go together; equal draws can't tie, as each is by its id.
    """
    return mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row: nulls for a null text, no ids for an empty one, a null id stays null, repeated rows each."""
    return bpe_encode(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("bpe", tokens)]

#: No SQL: a trained classifier, MinHash and the tokenizer are beyond it.  The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
