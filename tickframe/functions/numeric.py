"""Rounding, ratios and means that do not depend on row order.

A mean over doubles changes with the order in which partial sums meet, so a
retried task or another partition count can move a rounded value. Means are
therefore taken over decimals, where addition is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Adjusted prices carry many decimals; returns are rounded to four.
PRICE, RETURN, COUNT = "decimal(24,8)", "decimal(18,4)", "decimal(18,0)"
# Squares of values with four decimals, and their sums; one digit is left for a difference.
SQUARE = "decimal(37,8)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator, denominator) -> Column:
    """Division giving NULL, not an error, on a zero denominator."""
    return F.try_divide(col(numerator), col(denominator))


def pct_over(value, base, digits: int = 2) -> Column:
    """Distance of ``value`` from ``base`` in percent of ``base``."""
    return F.round(ratio(col(value) - col(base), base) * 100, digits)


def difference(a, b, digits: int) -> Column:
    """Rounded difference, taken on decimals so that a tie rounds half up."""
    return F.round(col(a).cast(PRICE) - col(b).cast(PRICE), digits).cast("double")


def mean(c, digits: int | None = None, dtype: str = PRICE) -> Column:
    """Exact mean of a group, rounded half up when ``digits`` is given."""
    exact = col(c).cast(dtype)
    if digits is None:
        return ratio(F.sum(exact).cast("double"), F.count(exact).cast("double"))
    return F.round(F.avg(exact), digits).cast("double")


def mean_count(c) -> Column:
    """Mean of a whole-number column, rounded to a whole number."""
    return F.round(F.avg(col(c).cast(COUNT)), 0).cast("long")


def clean_double(c) -> Column:
    """Cast to double; text that is no number, NaN and infinite values become NULL."""
    value = col(c).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)
