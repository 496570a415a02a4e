"""Profiles of tagged snapshots: overview, ages, discharge dates, stays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_MONTHS_MAX, LONG_STAY_FLOOR_DAYS, LONG_STAY_RANGES
from ..functions.classify import label_of, long_stay_range
from ..functions.dates import MICROS_PER_DAY, micros_to_days, span_micros
from ..functions.stats import round1
from .joins import null_safe_join
from .quantiles import weighted_median
from .sketches import sketched_quantile, value_sketches

OLD, NEW = "old", "new"

OVERVIEW_METRICS = ["n_rows", "min_admit", "max_admit", "null_discharge"]
DISCHARGE_METRICS = ["null_discharge", "min_discharge", "max_discharge", "discharge_before_admit"]
NUMERIC_METRICS = ["min", "median", "mean", "max", "n_null", "n_above_limit"]
COUNT_METRICS = {"n_rows", "null_discharge", "discharge_before_admit", "n_null", "n_above_limit"}


def overview_stats() -> dict[str, Column]:
    return {
        "n_rows": F.count(F.lit(1)),
        "min_admit": F.min("admit_ts"),
        "max_admit": F.max("admit_ts"),
        "null_discharge": F.count_if(F.col("discharge_ts").isNull()),
    }


def discharge_stats() -> dict[str, Column]:
    return {
        "null_discharge": F.count_if(F.col("discharge_ts").isNull()),
        "min_discharge": F.min("discharge_ts"),
        "max_discharge": F.max("discharge_ts"),
        "discharge_before_admit": F.count_if(F.col("discharge_ts") < F.col("admit_ts")),
    }


def snapshot_stats(tagged: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """Several aggregates per snapshot in one scan; map-side partials leave two rows a task."""
    return tagged.groupBy("snapshot").agg(*[c.alias(name) for name, c in stats.items()])


def snapshot_overview(tagged: DataFrame) -> DataFrame:
    """Rows, first and last admission, missing discharges: one row per snapshot."""
    return snapshot_stats(tagged, overview_stats())


def discharge_quality(tagged: DataFrame) -> DataFrame:
    """Missing, first and last discharge, and discharges before the admission."""
    return snapshot_stats(tagged, discharge_stats())


def snapshot_quality(tagged: DataFrame) -> DataFrame:
    """Overview and discharge quality together: both reports for one scan."""
    return snapshot_stats(tagged, {**overview_stats(), **discharge_stats()})


def strata(tagged: DataFrame) -> DataFrame:
    """Both quality profiles by snapshot, complexity, sex and code.

    One scan for every table that asks about these columns: ``merged`` brings the
    profiles back to a snapshot, and ``n_rows`` counts rows. As many rows as there are
    combinations.
    """
    stats = {**overview_stats(), **discharge_stats()}
    return tagged.groupBy("snapshot", "complexity", "sex", "dx").agg(
        *[c.alias(name) for name, c in stats.items()]
    )


def merged(parts: DataFrame) -> DataFrame:
    """Quality profiles of parts of the snapshots as those of whole snapshots."""

    def over(name: str) -> Column:
        if name in COUNT_METRICS:
            return F.sum(name)
        return F.min(name) if name.startswith("min_") else F.max(name)

    names = list(dict.fromkeys(OVERVIEW_METRICS + DISCHARGE_METRICS))
    return parts.groupBy("snapshot").agg(*[over(name).alias(name) for name in names])


def age_counts(tagged: DataFrame, value: str = "age_months") -> DataFrame:
    """Rows by snapshot and value."""
    return tagged.groupBy("snapshot", value).agg(F.count(F.lit(1)).alias("n"))


def stay_counts(tagged: DataFrame) -> DataFrame:
    """Rows by snapshot, complexity and stay in microseconds."""
    stay = span_micros(F.col("admit_ts"), F.col("discharge_ts"))
    return tagged.groupBy("snapshot", "complexity", stay.alias("stay_us")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _stay(rows: DataFrame) -> Column:
    if "stay_us" in rows.columns:
        return F.col("stay_us")
    return span_micros(F.col("admit_ts"), F.col("discharge_ts"))


def _rows(weight: str | None) -> Column:
    """Rows of a group, or the rows that counted ones stand for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def indicator_table(
    per_snapshot: DataFrame, metrics: Sequence[str], cast: str = "double"
) -> DataFrame:
    """One row per indicator and one column per snapshot, from one row per snapshot.

    A single global aggregate turns the two rows into one and unfolds it again. A
    snapshot without rows counts 0 and has no other values.
    """

    def of(snapshot: str, name: str) -> Column:
        value = F.max(F.when(F.col("snapshot") == snapshot, F.col(name).cast(cast)))
        return F.coalesce(value, F.lit(0).cast(cast)) if name in COUNT_METRICS else value

    rows = [
        F.struct(
            F.lit(name).alias("indicator"), of(OLD, name).alias("old"), of(NEW, name).alias("new")
        )
        for name in metrics
    ]
    return per_snapshot.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def numeric_profile(
    tagged: DataFrame,
    value: str = "age_months",
    limit: float = AGE_MONTHS_MAX,
    weight: str | None = None,
    accuracy: float | None = None,
) -> DataFrame:
    """Min, exact median, mean, max, missing values and values above a limit per snapshot.

    The rows are first counted by value, which bounds everything that follows by the
    number of distinct values. Rows without a snapshot are one of their own. ``weight``
    names the count of rows that were counted already.

    With ``accuracy`` the median is a sketch's, off by at most that share of the ranks (see
    ``sketches``), and all comes from one shuffle of a row per task and snapshot.
    """
    if accuracy is not None:
        _unweighted(weight)
        v = F.col(value)
        stats = {
            "mean": round1(F.avg(v)),
            "n_above_limit": F.count_if(v > F.lit(limit)),
        }
        return _sketched(tagged, v, accuracy, stats).select(
            "snapshot",
            F.col("low").cast(tagged.schema[value].dataType).alias("min"),
            F.col("median"),
            "mean",
            F.col("high").cast(tagged.schema[value].dataType).alias("max"),
            "n_null",
            "n_above_limit",
        )
    missing = F.col(value).isNull()
    hist = tagged.groupBy(
        "snapshot",
        missing.alias("missing"),
        F.coalesce(F.col(value), F.lit(0.0)).alias("v"),
    ).agg(_rows(weight).alias("n"))
    v, n = F.when(~F.col("missing"), F.col("v")), F.col("n")
    known = F.when(F.col("missing"), 0).otherwise(n)
    stats = hist.groupBy("snapshot").agg(
        F.min(v).alias("min"),
        round1(F.try_divide(F.sum(v * n), F.sum(known))).alias("mean"),
        F.max(v).alias("max"),
        F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("n_null"),
        F.sum(F.when(v > F.lit(limit), n).otherwise(0)).alias("n_above_limit"),
    )
    median = weighted_median(hist.withColumn("n", known), "snapshot", "v", "n")
    return null_safe_join(stats, median, ["snapshot"], "left").select(
        "snapshot", "min", "median", "mean", "max", "n_null", "n_above_limit"
    )


def _unweighted(weight: str | None) -> None:
    if weight is not None:
        raise ValueError("a sketch is made from rows: give either weight or accuracy")


def _sketched(
    tagged: DataFrame, value: Column, accuracy: float, stats: Mapping[str, Column]
) -> DataFrame:
    """Sketch, median and other aggregates per snapshot, in one grouping."""
    sketches = value_sketches(tagged, ["snapshot"], value, accuracy, stats)
    return sketches.withColumn("median", sketched_quantile(0.5)).drop("sketch")


def stay_stats(
    tagged: DataFrame, weight: str | None = None, accuracy: float | None = None
) -> DataFrame:
    """Min, exact median and max stay in days, zero and negative stays per snapshot.

    Rows without both dates do not count. Stays are whole microseconds until the end,
    so equality with zero and the median's order are exact. Rows without a snapshot are
    one of their own. Takes ``stay_counts`` too, with ``weight`` n.

    With ``accuracy`` the median is a sketch's, off by at most that share of the ranks, and
    all comes from one shuffle of a row per task and snapshot.
    """
    stay = _stay(tagged)
    if accuracy is not None:
        _unweighted(weight)
        stats = {"n_zero": F.count_if(stay == 0), "n_negative": F.count_if(stay < 0)}
        return _sketched(tagged, stay, accuracy, stats).select(
            "snapshot",
            round1(micros_to_days(F.col("low"))).alias("min_days"),
            round1(micros_to_days(F.col("median"))).alias("median_days"),
            round1(micros_to_days(F.col("high"))).alias("max_days"),
            "n_zero",
            "n_negative",
        )
    hist = tagged.groupBy(
        "snapshot",
        stay.isNull().alias("missing"),
        F.coalesce(stay, F.lit(0)).alias("v"),
    ).agg(_rows(weight).alias("n"))
    v, n = F.when(~F.col("missing"), F.col("v")), F.col("n")
    stats = hist.groupBy("snapshot").agg(
        F.min(v).alias("min_us"),
        F.max(v).alias("max_us"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("n_zero"),
        F.sum(F.when(v < 0, n).otherwise(0)).alias("n_negative"),
    )
    known = F.when(F.col("missing"), 0).otherwise(n)
    median = weighted_median(hist.withColumn("n", known), "snapshot", "v", "n")
    return null_safe_join(stats, median, ["snapshot"], "left").select(
        "snapshot",
        round1(micros_to_days(F.col("min_us"))).alias("min_days"),
        round1(micros_to_days(F.col("median"))).alias("median_days"),
        round1(micros_to_days(F.col("max_us"))).alias("max_days"),
        "n_zero",
        "n_negative",
    )


def long_stay_bins(
    tagged: DataFrame,
    floor_days: int = LONG_STAY_FLOOR_DAYS,
    ranges=LONG_STAY_RANGES,
    weight: str | None = None,
) -> DataFrame:
    """Stays above the floor by snapshot, right-closed range and complexity.

    Takes ``stay_counts`` too, with ``weight`` n.
    """
    return (
        tagged.withColumn("stay_us", _stay(tagged))
        .filter(F.col("stay_us") > F.lit(floor_days * MICROS_PER_DAY))
        .groupBy(
            "snapshot",
            long_stay_range(F.col("stay_us"), ranges).alias("range_ord"),
            "complexity",
        )
        .agg(_rows(weight).alias("n"))
        .select(
            "snapshot",
            "range_ord",
            label_of(F.col("range_ord"), [label for _, label in ranges]).alias("stay_range"),
            "complexity",
            "n",
        )
    )
