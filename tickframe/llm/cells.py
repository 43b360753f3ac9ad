"""Comparison of the entries under one key, in cells of bounded size.

Entries have a ``bucket``, and a ``side``: 0 looks, 1 stands. Every entry of
side 0 is to be compared with every one of side 1 in its bucket. Crowded
buckets are dealt into blocks of entries, and each pair of blocks is a cell, so
a task holds two blocks of a bucket at a time, however many entries it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays
from tickframe.llm.shared import written

BLOCK = 512
PAIRS_AT_ONCE = 200_000


def dealt(entries: DataFrame, block: int) -> DataFrame:
    """``entries`` with the cell's ``x`` and ``y``: blocks of side 0 and of side 1. ``node`` says which block."""
    is_looking = F.col("side") == 0
    sizes = entries.groupBy("bucket").agg(F.count(F.when(is_looking, 1)).alias("looking"), F.count(F.when(~is_looking, 1)).alias("standing"))
    crowded = written(sizes.where((F.col("looking") > block) | (F.col("standing") > block)))
    x_blocks, y_blocks = (F.coalesce(F.ceil(F.col(name) / block), F.lit(1)).cast("int") for name in ("looking", "standing"))
    placed = entries.join(crowded, "bucket", "left").withColumn("x_blocks", F.greatest(x_blocks, F.lit(1))).withColumn("y_blocks", F.greatest(y_blocks, F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.when(is_looking, F.col("x_blocks")).otherwise(F.col("y_blocks"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(is_looking, F.col("y_blocks")).otherwise(F.col("x_blocks")) - 1))
    placed = placed.withColumn("own", own).withColumn("across", across)
    x = F.when(is_looking, F.col("own")).otherwise(F.col("across"))
    y = F.when(is_looking, F.col("across")).otherwise(F.col("own"))
    return placed.withColumn("x", x).withColumn("y", y).select(*entries.columns, "x", "y")


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by cell as tables of whole cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "x", "y")], axis=1)
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        if len(last):
            cut = int(last[-1]) + 1
            yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the entries of side 0 and of side 1 in each cell, some at a time."""
    bucket, x, y, side = (rows.column(c).to_numpy() for c in ("bucket", "x", "y", "side"))
    new = np.ones(rows.num_rows, bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    cell = np.cumsum(new) - 1
    looking = np.bincount(cell[side == 0], minlength=cell[-1] + 1)
    standing = np.bincount(cell[side == 1], minlength=cell[-1] + 1)
    first = np.flatnonzero(new)
    # Entries of side 0 come first in a cell.
    left = np.flatnonzero(side == 0)
    left = left[standing[cell[left]] > 0]
    width = standing[cell[left]]
    ends = np.cumsum(width)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(left[lo:hi], width[lo:hi])
        yield i, first[cell[i]] + looking[cell[i]] + arrays.within(width[lo:hi])
        lo = hi


def fixed(column: pa.ChunkedArray, dtype: type | np.dtype, rows: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(rows, -1)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    offsets = whole.offsets.to_numpy()
    return offsets - offsets[0], whole.flatten().to_numpy(zero_copy_only=False)
