"""Mixing sources to target weights, to the word.

Sources have weights and share a budget of words. Every document gets a random
key, a hash of its id, text and a seed; a source's documents are taken in the
order of their keys. The order is cut into ranges of keys of about equal size.
Sums by range, then running sums over blocks of ranges and inside them, say how many
words lie before each range, so that only the one range of a source that
contains its cut is put in order row by row. A source whose target is larger
than itself is taken once in full for each whole epoch, then cut.

Sources are put in code-point order, null last, and take the weights in turn.
A target stops at ``most_epochs`` times its source's size; the excess is shared
again, by weight, among the others. Targets are doubles; the cut is at the
target rounded half up. The document at the cut is taken in part, so a source's
taken words sum to its rounded target.

A null or empty text has size 0 and is never taken. Documents that repeat with
the same id and text have equal keys; among them the order is arbitrary, but
since they are alike the multiset of results is the same on every run. Very
long texts are counted whole. An empty table gives an empty table. Extra
columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.shared import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Rows of one range of keys, on average.
RANGE_ROWS = 5_000
#: Ranges whose sums are run up together: a task sees so many of a source's ranges, or one row for each block of them.
BLOCK_RANGES = 2_000

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 09 to 0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(row: Sequence[Column], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *row)


def with_rank(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 by code point, null last, counted by range so that no task gets all sources."""
    ordered = written(sources.withColumn("__null", F.col("source").isNull()).repartitionByRange("__null", "source").withColumn("__part", F.spark_partition_id()))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__null", "source"))
    return (
        ordered.join(before.select("__part", F.coalesce("__before", F.lit(0)).alias("__before")), "__part")
        .withColumn("rank", F.col("__before") + inside - 1)
        .drop("__part", "__null", "__before")
    )


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Each round gives what is left to the open sources by weight and closes those that reach their limit, until none
    does; the driver sees two sums a round.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(with_rank(sources).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most_epochs))))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    per_weight = 0.0
    # A source is closed once the level, words per unit of weight, would lift it to its limit; levels only rise.
    while True:
        closed = F.col("limit") <= F.col("weight") * F.lit(per_weight)
        taken, open_weight = rows.agg(
            F.sum(F.when(closed, F.col("limit")).otherwise(0.0)), F.sum(F.when(closed, 0.0).otherwise(F.col("weight")))
        ).first()
        level = max(total - (taken or 0.0), 0.0) / open_weight if open_weight else per_weight
        if level <= per_weight:
            break
        per_weight = level
    target = F.least(F.col("limit"), F.col("weight") * F.lit(per_weight))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _ahead(size: str, keys: Sequence[str], order: str) -> Column:
    """Sum over the rows before the own one."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, and how many whole ``epochs`` that holds.

    The columns named in ``carry`` come along; ``documents`` is then read twice, so that they are not shuffled.
    """
    measured = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        random_key([F.col(doc_id), F.col(text)], seed).alias("key"),
        *[F.col(c).alias(f"__{c}") for c in carry],
    )
    rows = written(measured.drop(*[f"__{c}" for c in carry]))
    n = rows.count()
    step = F.lit(2.0**64 / max(1, -(-n // RANGE_ROWS)))
    key_range = F.floor((F.col("key").cast("double") + F.lit(2.0**63)) / step)
    ranges = written(rows.withColumn("range", key_range).groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most_epochs)

    goal = F.round("target").cast("long")
    # Words before a range: those of the blocks of ranges before its own, and of the ranges before it inside the block.
    ranges = ranges.withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    blocks = ranges.groupBy("source", "block").agg(F.sum("range_size").alias("block_size"))
    blocks = blocks.select(F.col("source").alias("__in"), F.col("block").alias("__block"), _ahead("block_size", ["source"], "block").alias("before_block"))
    ranges = ranges.withColumn("before_range", _ahead("range_size", ["source", "block"], "range"))
    ranges = ranges.join(blocks, F.col("source").eqNullSafe(F.col("__in")) & (F.col("block") == F.col("__block"))).drop("__in", "__block", "block")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    # Written, so that its size is known and the documents are not shuffled for a small table.
    cuts = written(
        ranges.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("epochs", epochs)
        .withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
        .withColumn("before", F.col("before_block") + F.col("before_range"))
        .select(
            F.col("source").alias("__source"), F.col("range").alias("__range"), "source_size", "target", "epochs",
            F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("range_size")).alias("part"), "range_size",
        )
    )
    placed = (measured if carry else rows).withColumn("range", key_range).join(cuts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range")))
    cut = (F.col("part") > 0) & (F.col("part") < F.col("range_size"))
    whole = placed.where(~cut).withColumn("once", F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("__source", "__range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(order), F.lit(0))
    sliced = placed.where(cut).withColumn("once", F.least(F.greatest(F.col("part") - ahead, F.lit(0)), F.col("size")))
    return whole.unionByName(sliced).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("once")).alias("taken"), "epochs",
        *[F.col(f"__{c}").alias(c) for c in carry],
    )
