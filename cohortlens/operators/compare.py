"""Counts of two snapshots side by side: categories, whole-number values, code lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_MONTHS_MAX, AGE_MONTHS_MIN, PRESENT_IN_BOTH, STUDY_CODES
from ..functions.classify import presence_status
from ..functions.stats import share_pct, zero
from ..sources.dims import code_spine, int_spine
from .joins import null_safe_join
from .profile import NEW, OLD
from .reconcile import count_in


def in_snapshot(snapshot: str, weight: str | None) -> Column:
    """Rows of a snapshot, or the rows that counted ones stand for."""
    if weight is None:
        return count_in(snapshot)
    return F.sum(F.when(F.col("snapshot") == snapshot, F.col(weight)).otherwise(0))


def side_counts(tagged: DataFrame, *keys: str | Column, weight: str | None = None) -> DataFrame:
    """Rows of each snapshot per key: one shuffle, and NULL is a key like any other.

    ``weight`` names the count of rows that were counted already.
    """
    return tagged.groupBy(*keys).agg(
        in_snapshot(OLD, weight).alias("n_old"), in_snapshot(NEW, weight).alias("n_new")
    )


def with_difference(counts: DataFrame) -> DataFrame:
    return counts.withColumn("difference", F.col("n_new") - F.col("n_old"))


def category_diff(tagged: DataFrame, category: str, weight: str | None = None) -> DataFrame:
    """Counts per category of either snapshot and their difference."""
    return with_difference(side_counts(tagged, category, weight=weight))


def category_diff_share(
    tagged: DataFrame, category: str, weight: str | None = None
) -> DataFrame:
    """As ``category_diff`` with the share inside each snapshot.

    A category absent from a snapshot has count 0 but no share. The two totals are a
    scalar subquery over the same counts, whose shuffle Spark reuses.
    """
    counts = side_counts(tagged, category, weight=weight)
    totals = counts.agg(
        F.struct(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
    ).scalar()

    def share(n: str) -> Column:
        return F.when(F.col(n) > 0, share_pct(F.col(n), totals.getField(n)))

    return with_difference(
        counts.withColumn("pct_old", share("n_old")).withColumn("pct_new", share("n_new"))
    )


def dense_histogram_diff(
    tagged: DataFrame,
    value: str = "age_months",
    low: int = AGE_MONTHS_MIN,
    high: int = AGE_MONTHS_MAX,
    weight: str | None = None,
) -> DataFrame:
    """Counts for every whole number low..high; other, missing or broken values fall out.

    At most one row per spine value reaches the join, so that side may be broadcast.
    """
    v = F.col(value)
    inside = tagged.filter(v.between(low, high) & (v == F.floor(v)))
    counts = side_counts(inside, v.cast("int").alias(value), weight=weight)
    return with_difference(_on_spine(int_spine(tagged.sparkSession, low, high, value), counts, value))


def codelist_coverage(
    tagged: DataFrame,
    codes: Sequence[str] | DataFrame = STUDY_CODES,
    column: str = "dx",
    weight: str | None = None,
) -> DataFrame:
    """Counts, difference and presence status for every code of a list.

    ``codes`` are hand-written, or a frame with a column of that name; null is no code.
    They are stacked on the rows and counted together. So a list of any length takes one
    shuffle of partial counts and no join, and a row's code is computed once.
    """
    if isinstance(codes, DataFrame):
        spine = codes.select(column).filter(F.col(column).isNotNull())
    else:
        spine = code_spine(tagged.sparkSession, codes, column)
    n = F.lit(1) if weight is None else F.col(weight)
    rows = tagged.select(column, "snapshot", n.cast("long").alias("n"), F.lit(False).alias("listed"))
    listed = spine.select(
        column,
        F.lit(None).cast("string").alias("snapshot"),
        F.lit(0).cast("long").alias("n"),
        F.lit(True).alias("listed"),
    )
    counts = (
        rows.unionByName(listed)
        .groupBy(column)
        .agg(
            in_snapshot(OLD, "n").alias("n_old"),
            in_snapshot(NEW, "n").alias("n_new"),
            F.bool_or("listed").alias("listed"),
        )
        .filter("listed")
    )
    return with_difference(counts.select(column, "n_old", "n_new")).withColumn(
        "status", presence_status(F.col("n_old") > 0, F.col("n_new") > 0)
    )


def codelist_status_summary(coverage: DataFrame) -> DataFrame:
    """Codes per status."""
    return coverage.groupBy("status").agg(F.count(F.lit(1)).alias("n_codes"))


def codelist_problems(coverage: DataFrame) -> DataFrame:
    """Codes that are not in both snapshots."""
    return coverage.filter(F.col("status") != PRESENT_IN_BOTH)


def codelist_common(coverage: DataFrame) -> DataFrame:
    """Codes in both snapshots with their counts."""
    return coverage.filter(F.col("status") == PRESENT_IN_BOTH).drop("status")


def _on_spine(spine: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every spine value with its counts, 0 where there are none.

    The counts were filtered to the spine before grouping: no more rows than the spine.
    A null-safe join asks for no extra not-null filter, which would clean every row's
    key once more.
    """
    return null_safe_join(spine, F.broadcast(counts), [key], "left").select(
        key, zero(F.col("n_old")).alias("n_old"), zero(F.col("n_new")).alias("n_new")
    )
