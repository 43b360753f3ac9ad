"""Row numbers over a whole table, without a window that one task works on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART, _N, _BEFORE, _INSIDE = "_part", "_n", "_before", "_inside"


def numbered(df: DataFrame, order: Sequence[str | Column], into: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``into``, each row's place from 0 in the order of some columns, nulls first unless they say otherwise.

    Rows are dealt over tasks by ranges of the order, sorted and numbered there,
    and written by ``store``, which reads them back: one shuffle of the rows. A
    row's number is its place inside its range plus the sizes of the ranges
    before, so the one window without a key sees a row a range; there are no more
    ranges than shuffle partitions, so their sizes go to every task. Rows of equal
    order go to one task: name columns that tell them apart.
    """
    # The lower 33 bits of the id count the rows of a task, in the order they are in.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({_PART: F.spark_partition_id(), _INSIDE: inside}))
    sizes = ranged.groupBy(_PART).agg(F.count("*").alias(_N))
    before = sizes.select(_PART, (F.sum(_N).over(Window.orderBy(_PART)) - F.col(_N)).alias(_BEFORE))
    return ranged.join(F.broadcast(before), _PART).withColumn(into, F.col(_INSIDE) + F.col(_BEFORE)).drop(_PART, _BEFORE, _INSIDE)
