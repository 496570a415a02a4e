from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_with_null(*cols: str | Column) -> Column:
    """Distinct count where NULL is one more value, for one column or a composite key."""
    return F.count_distinct(F.struct(*cols))


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def round1(col: Column) -> Column:
    """One decimal, ties to even."""
    return F.bround(col, 1)


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage of a whole with one decimal; NULL when the whole is 0."""
    return round1(F.try_divide(F.lit(100.0) * part, whole))
