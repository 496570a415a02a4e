"""Audit of two dimensions that should say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import union_all


def dimension_audit(first: DataFrame, second: DataFrame, code: str, label: str) -> DataFrame:
    """Code and label pairs that only one of two dimensions has, with which of them.

    A code that only one has is listed with each of its labels, NULL included; a code with
    several labels is compared label by label. One grouping over the stacked rows takes
    the place of a full outer join and matches NULL codes and labels.
    """
    stacked = union_all(
        [
            df.select(F.lit(side).alias("side"), F.col(code), F.col(label).alias("label"))
            for side, df in (("first", first), ("second", second))
        ]
    )
    return (
        stacked.groupBy(code, "label")
        .agg(*[F.bool_or(F.col("side") == side).alias(f"in_{side}") for side in ("first", "second")])
        .filter("in_first != in_second")
    )
