from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    ABSENT_IN_BOTH,
    CARE_LEVELS,
    DURATION_CLASSES,
    LONG_STAY_RANGES,
    ONLY_IN_NEW,
    ONLY_IN_OLD,
    PRESENT_IN_BOTH,
)
from .dates import MICROS_PER_DAY


def right_closed_bin(value: Column, uppers: list[float | None]) -> Column:
    """1-based number of the first bin whose upper bound is not exceeded; NULL stays NULL."""
    tests = [value.isNotNull() if u is None else value <= F.lit(u) for u in uppers]
    return F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(tests, start=1)])


def label_of(ordinal: Column, labels: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), ordinal)


def duration_class(days: Column, classes=DURATION_CLASSES) -> Column:
    """Ordinal of the duration class in 30-day months; negative spans fall in the first."""
    return right_closed_bin(days / F.lit(30.0), [u for u, _ in classes])


def long_stay_range(micros: Column, ranges=LONG_STAY_RANGES) -> Column:
    """Ordinal of the long-stay range. Bounds are compared in microseconds, so exactly."""
    return right_closed_bin(
        micros, [None if u is None else u * MICROS_PER_DAY for u, _ in ranges]
    )


def presence_status(in_old: Column, in_new: Column) -> Column:
    return (
        F.when(~in_old & ~in_new, F.lit(ABSENT_IN_BOTH))
        .when(in_old & ~in_new, F.lit(ONLY_IN_OLD))
        .when(~in_old & in_new, F.lit(ONLY_IN_NEW))
        .otherwise(F.lit(PRESENT_IN_BOTH))
    )


def care_level(flags: list[str] | None = None) -> Column:
    """Highest care level reached, 1..n in rising severity; NULL when no flag is true."""
    names = flags or [name for name, _ in CARE_LEVELS]
    return F.coalesce(
        *[F.when(F.col(name), F.lit(i)) for i, name in reversed(list(enumerate(names, 1)))]
    )
