"""Mixing sources to target weights by iterative proportional fitting.

The tokens of the cells (source, language, topic) are raked to the target shares of the three
marginals, one after the other, ``SWEEPS`` times.  The solution is the cells' own tokens times one
factor for each source, language and topic, so only those three short tables meet the documents.
A document's weight is the product of its factors; its inclusion probability is its weight scaled
so that the expected tokens of the sample are the budget, with 1 as the most; by default the
budget is the largest at which no probability is cut off, which makes the expected marginals
exactly the targets.  A document is in the sample if a uniform number from its id is below that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, place, whole

#: Targets are the natural shares to this power, made to add up to one: large sources give way to small ones.
ALPHA, SWEEPS = 0.9, 25
MARGINS = ("source", "lang", "topic")


def topic(text):
    """A topic by form, for tables that have no such column: the first of these that holds."""
    size = F.length(text)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(text.contains("License"), "licensed").when(text.contains("@"), "contacts").when(text.contains(" | "), "tabular")
        .when(size >= 4000, "longform").when(size >= 1000, "article").otherwise("note")
    )


TOPIC_SQL = "CASE WHEN text IS NULL THEN NULL WHEN contains(text, 'License') THEN 'licensed' WHEN contains(text, '@') THEN 'contacts' WHEN contains(text, ' | ') THEN 'tabular' WHEN length(text) >= 4000 THEN 'longform' WHEN length(text) >= 1000 THEN 'article' ELSE 'note' END"


def tokens(text):
    """Words as white space has them, by its spaces; 0 for a null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


TOKENS_SQL = "CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END"


def uniform(key):
    """A number in [0, 1) from the id alone: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


UNIFORM_SQL = "('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


def rake(codes: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS) -> list[np.ndarray]:
    """Factors by margin: ``codes`` has one column of level numbers for each margin, ``mass`` each cell's tokens."""
    factors = [np.ones(len(t)) for t in targets]
    for _ in range(sweeps):
        for k, target in enumerate(targets):
            weight = mass.copy()
            for j, f in enumerate(factors):
                weight *= f[codes[:, j]]
            have = np.bincount(codes[:, k], weight, len(target))
            factors[k] = factors[k] * np.divide(target, have, out=np.ones(len(target)), where=have > 0)
    return factors


def scale(weights: np.ndarray, mass: np.ndarray, budget: float | None) -> float:
    """c for which the sum of mass * min(1, c * weight) is the budget; without one, 1 over the largest weight."""
    live = mass > 0
    if not live.any():
        return 1.0
    w, m = weights[live], mass[live]
    if budget is None:
        return float(1 / w.max())
    order = np.argsort(-w)
    w, m = w[order], m[order]
    full = np.append(0, np.cumsum(m))[:-1]  # tokens of the cells before, all taken
    rest = np.cumsum((w * m)[::-1])[::-1]
    for k in range(len(w)):
        c = (budget - full[k]) / rest[k]
        if c * w[k] <= 1:
            return float(max(c, 0))
    return float(1 / w[-1])


def weighted(df: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None, targets: dict[str, dict] | None, alpha: float, sweeps: int, budget_share: float | None) -> DataFrame:
    """``df`` with its columns called c0, c1, ... and columns id, tokens, weight and probability."""
    whole(df, id_col)
    at = {name: F.col(f"c{place(df, name)}") for name in (id_col, text_col, source_col, lang_col, topic_col) if name}
    names, n = [f"margin_{m}" for m in MARGINS], "tokens"
    levels = [F.coalesce(x.cast("string"), F.lit("")) for x in (at[source_col], at[lang_col], at[topic_col] if topic_col else topic(at[text_col]))]
    marked = by_place(df).withColumns({**dict(zip(names, levels, strict=True)), n: tokens(at[text_col]), "id": at[id_col].cast("long")})
    # as many rows as combinations that occur, whatever the number of documents
    cells = marked.groupBy(*names).agg(F.sum(n).alias(n)).orderBy(*names).toArrow()
    mass = cells.column(n).to_numpy().astype(float)
    total, codes, level, want = mass.sum(), [], [], []
    for m, name in zip(MARGINS, names, strict=True):
        values = cells.column(name).to_pylist()
        seen = sorted(set(values))
        code = np.searchsorted(np.array(seen, object), np.array(values, object)) if seen else np.zeros(0, np.int64)
        have = np.bincount(code, mass, len(seen))
        own = (targets or {}).get(m)
        share = np.array([own.get(x, 0.0) for x in seen]) if own else np.power(have / total, alpha) if total else np.zeros(len(seen))
        share = np.where(have > 0, share, 0)
        want.append(share / share.sum() * total if share.sum() else have)
        codes.append(code)
        level.append(seen)
    grid = np.stack(codes, 1).astype(np.int64)
    factors = rake(grid, mass, want, sweeps)
    weights = np.prod([f[grid[:, k]] for k, f in enumerate(factors)], axis=0) if len(mass) else np.zeros(0)
    c = scale(weights, mass, None if budget_share is None else budget_share * total)
    for name, seen, f in zip(names, level, factors, strict=True):
        small = df.sparkSession.createDataFrame(pa.table({name: pa.array(seen, pa.string()), f"{name}_factor": pa.array(f, pa.float64())}))
        marked = marked.join(small, name)  # Spark broadcasts it if it is small enough
    product = F.col(f"{names[0]}_factor") * F.col(f"{names[1]}_factor") * F.col(f"{names[2]}_factor")
    return marked.withColumn("weight", product).withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("weight")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict] | None = None, alpha: float = ALPHA, sweeps: int = SWEEPS, budget_share: float | None = None) -> DataFrame:
    """(doc_id, tokens, weight, probability) of the documents in the sample.

    ``targets`` has shares by margin and level (a level it leaves out gets none); a margin it
    leaves out gets the natural shares to the power ``alpha``.  A null source, language or topic
    is the level "" of its margin; a document without tokens has its levels' weight like any other;
    a null id never is in the sample, rows that repeat an id are in it or out of it together;
    the tokens of a text of any length all count; of an empty table the sample is empty.  Ids must be
    integers; other columns, whatever their names, aren't read.
    """
    out = weighted(df, id_col, text_col, source_col, lang_col, topic_col, targets, alpha, sweeps, budget_share)
    chosen = out.where(uniform(F.col("id")) < F.col("probability"))
    return chosen.select(F.col("id").alias("doc_id"), "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def mix_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict] | None = None, alpha: float = ALPHA, sweeps: int = SWEEPS, budget_share: float | None = None) -> DataFrame:
    """The sample of ``mix`` as rows of ``df``, with all its columns; what holds there holds here."""
    out = weighted(df, id_col, text_col, source_col, lang_col, topic_col, targets, alpha, sweeps, budget_share)
    return out.where(uniform(F.col("id")) < F.col("probability")).select(*[f"c{k}" for k in range(len(df.columns))]).toDF(*df.columns)


def sql(alpha: float = ALPHA, sweeps: int = SWEEPS) -> str:
    """``mix`` over the view documents as one statement, with the sweeps written out."""
    parts = [f"base AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce({TOPIC_SQL}, '') AS topic, ({TOKENS_SQL})::BIGINT AS tokens FROM documents)",
             "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass FROM base GROUP BY ALL)", "total AS (SELECT sum(mass) AS total FROM cells)"]
    for m in MARGINS:
        parts.append(f"share_{m} AS (SELECT {m}, pow(sum(mass) / (SELECT total FROM total), {alpha}) AS share FROM cells GROUP BY {m})")
        parts.append(f"want_{m} AS MATERIALIZED (SELECT {m}, share / (SELECT sum(share) FROM share_{m}) * (SELECT total FROM total) AS want FROM share_{m})")
    last = "cells_0"
    parts.append("cells_0 AS (SELECT *, mass AS fitted FROM cells)")
    for k in range(sweeps):
        for m in MARGINS:
            name = f"fit_{k}_{m}"
            parts.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.mass, c.fitted * w.want / sum(c.fitted) OVER (PARTITION BY c.{m}) AS fitted FROM {last} c JOIN want_{m} w ON w.{m} = c.{m})")
            last = name
    parts.append(f"weights AS MATERIALIZED (SELECT source, lang, topic, fitted / mass AS weight FROM {last} WHERE mass > 0)")
    parts.append("most AS (SELECT max(weight) AS most FROM weights)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT b.doc_id, b.tokens, round(w.weight, 6) AS weight, round(least(1.0, w.weight / (SELECT most FROM most)), 6) AS probability FROM base b JOIN weights w USING (source, lang, topic) WHERE {UNIFORM_SQL} < least(1.0, w.weight / (SELECT most FROM most))"
