"""Word highlights: the first words of a text that are close enough to a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, span_rows
from ..functions.vector import cosine_similarity
from .embedder import Embedder


def highlight_rows(docs: DataFrame, query: Column, embedder: Embedder, key: str, text: str, n: int, also: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, highlights) for each row: the first ``n`` words, in order, whose cosine with ``query`` is above the strict threshold.

    The query isn't stripped, and words of one letter count.  Each word is embedded by itself, by a model once for each distinct word of a batch.
    With ``also`` only words for which it is true count; it is asked first.
    """
    tiles = span_rows(docs, F.col(text), key, delimiters=WORD, drop=("pos", "type"))
    if also:
        tiles = tiles.where(also(F.col("contents")))
    near = tiles.where(cosine_similarity(embedder.embed(F.col("contents")), query) > embedder.strict_threshold)
    found = near.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("start_i", "end_i"))), 1, max(n, 1)).alias("highlights"))
    return found if n > 0 else found.where(F.lit(False))
