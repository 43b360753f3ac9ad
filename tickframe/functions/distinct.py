"""Exact distinct counts that merge: bitmaps over dictionary codes, kept as their non-empty 64-bit words.

A value has a code, a small whole number; the codes that a group holds are bits.
Words of the same group and place merge by OR, over tasks as over days, so a
profile of new bars is added to a stored one without reading the old bars, and a
count of distinct values needs no row per value in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.numbering import numbered

WORD, BITS = "word", "bits"


def dictionary(df: DataFrame, column: str, store: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """``column`` and ``code`` of its distinct values other than NULL; ``known`` ones keep their codes."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    if known is None:
        return numbered(values, [column], "code", store)
    free = known.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    new = numbered(values.join(known, column, "left_anti"), [column], "code", store)
    return known.unionByName(new.withColumn("code", F.col("code") + F.lit(free)))


def words(df: DataFrame, keys: Sequence[str], code: Column) -> DataFrame:
    """The bitmap of codes of each group: ``word``, its place, and ``bits``. Rows without a code set no bit."""
    coded = df.select(*keys, code.cast("long").alias("_code")).where("_code IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_code").bitwiseAND(F.lit(63)).cast("int"))
    return coded.groupBy(*keys, F.shiftright("_code", 6).alias(WORD)).agg(F.bit_or(bit).alias(BITS))


def merged(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One bitmap per group from bitmaps over the same codes."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, WORD).agg(F.bit_or(BITS).alias(BITS))


def counts(bitmaps: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
    """How many distinct values each group has."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count(BITS)).cast("long").alias(into))
