"""Neighbours in a sorted order that spans the whole table, however its rows are dealt over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tickframe.llm.shared import written

#: Given sorted rows and the index pairs (earlier, later) of neighbours, the rows to return.
Emit = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]


def _runs(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of rows of equal keys begin; without keys each row is a run."""
    new = np.ones(rows.num_rows, bool)
    if keys and rows.num_rows > 1:
        columns = [rows.column(k).to_numpy() for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _pairs(rows: pa.Table, width: int, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows at most ``width`` places apart, and each row with the last one of the run before its own and the first one of the run after it."""
    n = rows.num_rows
    earlier, later = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, min(width, n - 1) + 1):
        j = np.arange(k, n)
        earlier.append(j - k)
        later.append(j)
    if keys and n:
        begin = _runs(rows, keys)
        lengths = np.diff(np.append(begin, n))
        start, end = np.repeat(begin, lengths), np.repeat(begin + lengths, lengths)
        at = np.arange(n)
        has = (start > 0) & (at - start + 1 > width)
        earlier.append(start[has] - 1)
        later.append(at[has])
        has = (end < n) & (end - at > max(width, 1))
        earlier.append(at[has])
        later.append(end[has])
    return np.concatenate(earlier), np.concatenate(later)


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def neighbours(df: DataFrame, order: list[str], width: int, emit: Emit, schema: str, runs: list[str] | None = None) -> DataFrame:
    """``emit`` for all pairs of rows at most ``width`` places apart in the order of the given columns.

    With ``runs``, columns whose equal values make a run of rows, also for each row and the nearest one of another run on
    either side, however long its own run is. A run is held until it ends.

    The table is range-partitioned by the whole order, so rows that share a
    prefix of it, or all of it, are split over tasks where they are many. Pairs
    across the borders of tasks come from each task's first and last ``width``
    rows and runs, which one task joins: their number follows the number of
    tasks, not that of rows. ``df`` is read twice and should be a written table.
    """
    out_schema = StructType.fromDDL(schema)
    names = out_schema.fieldNames()
    keys = runs or []

    def opening(rows: pa.Table) -> int:
        """How many rows at the front what stands before may look at; all while the first run is open."""
        begin = _runs(rows, keys)
        return min(rows.num_rows, max(width, int(begin[1]) + 1 if len(begin) > 1 else rows.num_rows))

    def closing(rows: pa.Table) -> int:
        """How many rows at the back what follows may look at."""
        return min(rows.num_rows, max(width, rows.num_rows - int(_runs(rows, keys)[-1]) + 1))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail, blank, total, is_open = None, None, None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = own = pa.Table.from_batches([batch])
            total += own.num_rows
            carried = 0
            if tail is not None:
                carried = tail.num_rows
                rows = pa.concat_tables([tail, rows])
            if is_open:
                head = own if head is None else pa.concat_tables([head, own])
                n = opening(head)
                is_open = n == head.num_rows
                head = head.slice(0, n).combine_chunks()
            i, j = _pairs(rows, width, keys)
            new = j >= carried
            found = emit(rows, i[new], j[new])
            blank = blank or [pa.nulls(1, f.type) for f in found.schema]
            yield from found.append_column("__edge", pa.nulls(found.num_rows, pa.binary())).to_batches()
            tail = rows.slice(rows.num_rows - closing(rows)).combine_chunks()
        if tail is not None:
            part = TaskContext.get().partitionId()
            over = head.num_rows + tail.num_rows - total
            # Head and tail of a task that they cover are one piece.
            whole = pa.concat_tables([head, tail.slice(max(0, over))])
            piece = np.zeros(whole.num_rows, np.int64)
            if over < 0:
                piece[head.num_rows :] = 1
            edge = whole.append_column("__part", pa.array(np.full(whole.num_rows, part))).append_column("__piece", pa.array(piece))
            yield pa.RecordBatch.from_arrays([*blank, pa.array([_pack(edge)], pa.binary())], [*names, "__edge"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [pa.ipc.open_stream(x.as_py()).read_all() for b in batches for x in b.column(0)]
        edges.sort(key=lambda t: t.column("__part")[0].as_py())
        held: list[pa.Table] = []

        def joined() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(held).combine_chunks()
            part = rows.column("__part").to_numpy()
            i, j = _pairs(rows, width, keys)
            cross = part[i] != part[j]
            yield from emit(rows.drop_columns(["__part", "__piece"]), i[cross], j[cross]).to_batches()

        # No row is missing between the last piece of a task and the first of the next.
        for edge in edges:
            first = int((edge.column("__piece").to_numpy() == 0).sum())
            held.append(edge.slice(0, first))
            if first < edge.num_rows:
                yield from joined()
                held = [edge.slice(first)]
        if held:
            yield from joined()

    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    both = written(spread.mapInArrow(inside, StructType.fromDDL(f"{schema}, __edge binary")))
    joined = both.where("__edge IS NOT NULL").select("__edge").coalesce(1).mapInArrow(across, out_schema)
    return both.where("__edge IS NULL").drop("__edge").unionByName(joined)
