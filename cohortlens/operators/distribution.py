"""Distribution tables by site with a total row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DURATION_CLASSES, TOTAL
from ..functions.classify import duration_class
from ..functions.dates import span_days
from ..functions.stats import share_pct, zero
from ..functions.text import count_pct_text, number_text


def totals_of(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    return df.agg(*[zero(F.sum(c)).alias(c) for c in sums])


def with_total(
    df: DataFrame, label: str, sums: Sequence[str], total_label: str = TOTAL
) -> DataFrame:
    """Detail rows and one row with their sums, told apart by ``row_ord`` (0 and 1).

    The total adds up the groups. A patient of two sites counts twice, so this is not
    the distinct count a rollup over the rows would give. Both branches read the same
    aggregate and Spark reuses its shuffle.
    """
    detail = df.select(F.lit(0).alias("row_ord"), label, *sums)
    total = totals_of(df, sums).select(
        F.lit(1).alias("row_ord"), F.lit(total_label).alias(label), *sums
    )
    return detail.unionByName(total)


def total_values(df: DataFrame, sums: Sequence[str]) -> Column:
    """The sums as one scalar struct, to be set beside every row without a join."""
    return totals_of(df, sums).select(F.struct(*sums)).scalar()


def patients_and_events(sample: DataFrame, by: str = "site") -> DataFrame:
    """Distinct patients and distinct patient events per site, NULL counted as a value.

    Three nested groupings, each with map-side partials. Two distinct counts in one
    aggregate would copy every row once per count, and its plan is not reused by the
    total. Copies of a row change nothing, so the rows need no deduplication first.
    """
    return (
        sample.select(by, "patient_id", "event_no")
        .distinct()
        .groupBy(by, "patient_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("patients"), F.sum("events").alias("events"))
    )


def _distribution(sample: DataFrame, total_with_pct: bool) -> DataFrame:
    sums = ["patients", "events"]
    counts = patients_and_events(sample)
    total = total_values(counts, sums)
    is_total = F.col("row_ord") == 1

    def pct(n: str) -> Column:
        return share_pct(F.col(n), total.getField(n))

    def text(n: str) -> Column:
        cell = count_pct_text(F.col(n), F.col(f"pct_{n}"))
        return cell if total_with_pct else F.when(is_total, number_text(F.col(n))).otherwise(cell)

    return (
        with_total(counts, "site", sums)
        .withColumns({f"pct_{n}": pct(n) for n in sums})
        .withColumns({f"{n}_text": text(n) for n in sums})
    )


def site_distribution(sample: DataFrame) -> DataFrame:
    """Patients and events per site with their share; the total row shows plain numbers."""
    return _distribution(sample, total_with_pct=False)


def group_counts(sample: DataFrame, group: str) -> DataFrame:
    """As ``site_distribution`` for one subgroup; here the total row shows its 100%.

    Sites without a row in the group are absent.
    """
    return _distribution(sample.filter(F.col("subgroup") == group), total_with_pct=True)


def duration_distribution(
    events: DataFrame, groups: Sequence[str], classes=DURATION_CLASSES
) -> DataFrame:
    """Unique events of some subgroups by site and duration class.

    A site row shows shares of its own total, the total row shares of the table total.
    Events without a duration are a column of their own, counted in the total but shown
    without a share, so the shares of a row need not add up to 100.
    """
    bins = [f"bin_{i}" for i, _ in enumerate(classes, 1)]
    counted = [*bins, "bin_na"]
    ordinal = duration_class(span_days(F.col("event_start"), F.col("event_end")), classes)
    counts = (
        events.filter(F.col("subgroup").isin(*groups))
        .withColumn("bin", ordinal)
        .groupBy("site")
        .agg(
            *[F.count_if(F.col("bin") == i).alias(b) for i, b in enumerate(bins, 1)],
            F.count_if(F.col("bin").isNull()).alias("bin_na"),
        )
        .withColumn("total", sum((F.col(b) for b in counted), F.lit(0)))
    )
    # The total row's own total is the total of the table.
    is_total = F.col("row_ord") == 1
    pcts = {f"pct_{b}": share_pct(F.col(b), F.col("total")) for b in bins}
    cells = {f"{b}_text": count_pct_text(F.col(b), F.col(f"pct_{b}")) for b in bins}
    total_cell = F.when(
        is_total, count_pct_text(F.col("total"), share_pct(F.col("total"), F.col("total")))
    ).otherwise(number_text(F.col("total")))
    return (
        with_total(counts, "site", [*counted, "total"])
        .withColumns(pcts)
        .withColumns(cells)
        .withColumn("total_text", total_cell)
    )
