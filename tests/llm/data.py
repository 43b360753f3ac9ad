"""Small hand-made tables: nulls, empties, ties, repeated rows, and columns whose names clash with results."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    filled = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in filled], DOCUMENTS)


def with_clashes(df: DataFrame, *names: str) -> DataFrame:
    """The same rows with columns that operators use for themselves."""
    return df.selectExpr("*", *[f"'x' AS {n}" for n in names])


def prose(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
