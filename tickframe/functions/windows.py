"""Rolling windows over one ordered series per key.

All windows over a series share one partitioning and one ordering, so Catalyst
shuffles and sorts a series once however many columns are derived from it.

Sums, means and deviations roll in constant time per row: a running total minus
the running total ``n`` rows back. Decimals keep that difference exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.numeric import PRICE, RETURN, SQUARE, col, ratio

BLOCK, IS_HALO = "_block", "_is_halo"


class Series:
    """Windows over rows of one key in the order of one column."""

    def __init__(self, keys: Sequence[str], order: str):
        self.ordered = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())

    def frame(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), Window.currentRow)

    def running(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(self, rows: DataFrame) -> DataFrame:
        """The same rows, dealt by key and sorted before anything is derived from them.

        What a window reads is computed below the shuffle that it asks for, and travels with the rows: decimals and
        their squares take more than the bars. This window reads nothing, so the shuffle is of the rows as they are;
        windows after it find them in place. The condition holds for every row and keeps the window in the plan.
        """
        return rows.withColumn("_place", F.row_number().over(self.ordered)).where("_place >= 1").drop("_place")

    def lag(self, c, n: int) -> Column:
        return F.lag(col(c), n).over(self.ordered)

    def extremes(self, rows: DataFrame, wanted: dict[str, tuple[str, Callable[..., Column], int]]) -> DataFrame:
        """``rows`` with ``{name: (column, F.greatest or F.least, n)}``: the extreme of the last ``n`` rows.

        Frames double: the extreme of 2k rows is that of k rows, and the same k rows back. Overlapping frames do not
        change an extreme, so two of the largest power of two that fits cover any frame. A frame of n rows takes log n
        look-backs whatever its size, in the order the series is in; frames of one column share them.
        """
        widest = max(n for _, _, n in wanted.values())
        names = {(c, pick): f"_{'high' if pick is F.greatest else 'low'}_{c}" for c, pick, _ in wanted.values()}
        rows = rows.withColumns({name: F.col(c) for (c, _), name in names.items()})
        size = 1
        while True:
            done = {into: (names[c, pick], pick, n - size) for into, (c, pick, n) in wanted.items() if size <= n < 2 * size}
            if done:
                rows = rows.withColumns({into: pick(name, self.lag(name, k)) if k else F.col(name) for into, (name, pick, k) in done.items()})
            if 2 * size > widest:
                return rows.drop(*names.values())
            rows = rows.withColumns({name: pick(name, self.lag(name, size)) for (_, pick), name in names.items()})
            size *= 2

    def squares(self, name: str, c) -> dict[str, Column]:
        """Running totals for ``deviation``: of the values, to four decimals, of their squares, and how many.

        A value may be up to 1e12 in size and a series a million rows long; the totals are exact then.
        """
        value = col(c).cast(RETURN)
        over = self.running()
        return {
            f"{name}_values": F.sum(value).over(over),
            f"{name}_squares": F.sum((value * value).cast(SQUARE)).over(over).cast(SQUARE),
            f"{name}_count": F.count(value).over(over),
        }

    def deviation(self, name: str, n: int) -> Column:
        """Sample standard deviation of the last ``n`` rows of a column prepared with ``squares``; NULL for fewer than two values.

        The cost of a row does not depend on ``n``, which may be up to 999; the squares of a frame may sum up to 1e26.
        """
        count = self.rolled(f"{name}_count", n)
        total = self.rolled(f"{name}_values", n).cast(RETURN)
        squares = self.rolled(f"{name}_squares", n).cast("decimal(34,8)")
        spread = (count.cast("decimal(3,0)") * squares).cast(SQUARE) - (total * total).cast(SQUARE)
        return F.when(count > 1, F.sqrt(spread.cast("double") / (count * (count - 1)).cast("double")))

    def totals(self, name: str, c, dtype: str = PRICE) -> dict[str, Column]:
        """Running total and count under ``<name>_total`` and ``<name>_seen``."""
        value = col(c).cast(dtype)
        return {
            f"{name}_total": F.sum(value).over(self.running()),
            f"{name}_seen": F.count(value).over(self.running()),
        }

    def rolled(self, c: str, n: int) -> Column:
        """Sum over the last ``n`` rows from a running total."""
        return F.coalesce(F.col(c), F.lit(0)) - F.coalesce(self.lag(c, n), F.lit(0))

    def mean(self, name: str, n: int, digits: int) -> Column:
        """Mean of the last ``n`` rows of a column prepared with ``totals``."""
        total, seen = self.rolled(f"{name}_total", n), self.rolled(f"{name}_seen", n)
        return F.round(ratio(total, seen), digits).cast("double")


def split_series(
    df: DataFrame, key: str, order: str, lookback: int, block_rows: int, unit: str = "month"
) -> DataFrame:
    """Cut each series into blocks that carry the rows their frames look back on.

    Slices (``unit`` of the ordering column) are counted, laid end to end per
    key and gathered into blocks of about ``block_rows`` rows: block ``b`` begins
    at or after row ``b * block_rows``. A slice goes to its own block and, flagged
    as halo, to every later block whose frames can reach its last row.
    """
    df = df.withColumn("_slice", F.date_trunc(unit, order))
    so_far = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        df.groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(so_far))
        .withColumn("_own", F.expr(f"(_end - _n) div {block_rows}"))
        .withColumn("_last", F.expr(f"(_end + {lookback} - 1) div {block_rows}"))
        .select(key, "_slice", "_own", F.expr("sequence(_own, greatest(_own, _last))").alias("_blocks"))
    )
    return (
        df.join(slices, [key, "_slice"])
        .withColumn(BLOCK, F.explode("_blocks"))
        .withColumn(IS_HALO, F.col(BLOCK) != F.col("_own"))
        .drop("_slice", "_own", "_blocks")
    )


def over_series(
    df: DataFrame,
    key: str,
    order: str,
    lookback: int,
    build: Callable[[DataFrame, Series], DataFrame],
    block_rows: int | None = None,
) -> DataFrame:
    """Apply ``build`` to each series, in blocks when ``block_rows`` is given."""
    if block_rows is None:
        return build(df, Series([key], order))
    blocks = split_series(df, key, order, lookback, block_rows)
    out = build(blocks, Series([key, BLOCK], order))
    return out.where(~F.col(IS_HALO)).drop(BLOCK, IS_HALO)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """Best ``k`` rows per group; Catalyst limits each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
