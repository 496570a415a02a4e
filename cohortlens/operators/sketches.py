"""Quantile sketches: small states that can be stored for each part of the data and merged."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest and smallest state that the sketch takes.
_K_MIN, _K_MAX = 8, 65535


def sketch_size(accuracy: float) -> int:
    """The state's parameter for a rank error of ``accuracy`` (0.01: one rank in a hundred).

    The error is 2.296 / k**0.9723 of all values, with 99% confidence.
    """
    if not 0 < accuracy < 1:
        raise ValueError("accuracy is a share of the ranks, between 0 and 1")
    return max(_K_MIN, min(_K_MAX, math.ceil((2.296 / accuracy) ** (1 / 0.9723))))


def value_sketches(
    rows: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    accuracy: float,
    stats: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per key: ``n`` values, ``n_null``, ``low``, ``high`` and their ``sketch``.

    ``stats`` adds other aggregates of the rows.

    NULL and NaN are no values; NULL keys are a group. Every task sends one state of
    bounded size per key, so a key with a third of all rows costs no more than another.
    Store the frame (a snapshot, a day) and merge it with others later.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    v = F.when(~F.isnan(v), v)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.count_if(v.isNull()).alias("n_null"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, F.lit(sketch_size(accuracy))).alias("sketch"),
        *[c.alias(name) for name, c in (stats or {}).items()],
    )


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of parts as those of the wholes that ``keys`` tell apart.

    The error stays that of the parts; parts of different accuracy take the larger one.
    """
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("n_null").alias("n_null"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketched_quantile(rank: float, sketch: str = "sketch", n: str = "n") -> Column:
    """A value of the data whose rank is ``rank`` of all, within the error; NULL of none.

    Rank 0 and 1 are the exact minimum and maximum.
    """
    return F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(rank))))
