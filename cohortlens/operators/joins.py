"""Joins in which NULL keys match each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL; ``right`` must be unique by key.

    Null-safe keys are hashed through an expression of their own, so both sides are
    exchanged right below the sort-merge join even when ``right`` was just aggregated
    by the same keys. That is the shape adaptive execution needs to split a hot key of
    the left side over several tasks.
    """
    renamed = right.select(*[right[c].alias(f"__r_{c}") for c in right.columns])
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [renamed[f"__r_{c}"].alias(c) for c in right.columns if c not in keys]
    return joined.select(*[left[c] for c in left.columns], *extra)
