"""The subpackage's queries and their SQL, by name; ``__spark_entry__.py`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import spread
from . import ann, bpe, exact_dedup, html, huffman, minhash, mixing, quality, toxicity, warc
from .common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``html.extract`` of all pages: one row for each, with null text for a null page, "" for an empty one; repeated rows each, none of an empty table."""
    return html.extract(pages(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bpe.bpe_encode`` of all documents: one row for each, with nulls for a null text, no ids for an empty one; long texts whole, repeated rows each, none of an empty table."""
    return bpe.bpe_encode(documents(spark, sf_dir))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``minhash.near_duplicates`` of all documents: one row for each but the least id of its group; null ids, null texts and texts without a token are in none; none of an empty table."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``warc.salvaged_pages``: all pages through damaged archives and back, with the gaps; nulls and empties come back as such, repeated rows each, nothing of an empty table."""
    return warc.salvaged_pages(table(spark, sf_dir, "pages"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ann.nearest``: rows whose id is divisible by 100 against all rows; null ids and vectors are left out, ties go to the lesser id, repeated rows count once; none of an empty table."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mixing.mix`` of all documents: the sample; a null level is a level, a null or empty text has no tokens, a null id is never drawn, repeated rows together; none of an empty table."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity.score_toxicity`` of all documents: one row for each; a null or empty text has 0, long texts are read whole, repeated rows each; none of an empty table."""
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality.score_quality`` of all documents: one row for each; a null text is read as an empty one, long texts whole, repeated rows each; none of an empty table."""
    return quality.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``huffman.huffman_encode`` of the token ids of all documents: their blocks; null data for a null text, a block of nothing for an empty one, as many blocks as a long one needs, repeated rows each; none of an empty table."""
    ids = written(bpe.bpe_encode(documents(spark, sf_dir), check=False).select("doc_id", "token_ids"), "token-ids")
    return huffman.huffman_encode(ids, huffman.codebook(ids))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup.exact_duplicates`` of all documents: one row for each but the least id of its text; a null text equals nothing, empty texts one another, long ones are compared whole; none of an empty table."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html, op2_bpe, op3_minhash, op4_warc, op5_ann, op6_mixing, op7_toxicity, op8_quality, op9_huffman, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.sql(),
        "op10_exact_dedup": """
            SELECT doc_id, dup_of FROM (
                SELECT doc_id, first_value(doc_id) OVER w AS dup_of, row_number() OVER w AS place
                FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
            ) WHERE place > 1""",
    }
