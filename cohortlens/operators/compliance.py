"""Enrolment against targets, by site and by collector."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPLIANCE_THRESHOLD, TOTAL
from ..functions.dates import monday_of, reporting_window, week_label, week_start
from ..functions.stats import distinct_with_null, share_pct, zero
from ..functions.text import count_pct_text, number_text, pct_text, relabel
from .distribution import totals_of


def enrolled(enrolment: DataFrame, cutoff: dt.date) -> DataFrame:
    """Eligible registrations up to the cutoff, that day included; unknown is not eligible."""
    return enrolment.filter(F.col("eligible") & (F.col("reg_date") <= F.lit(cutoff)))


def site_status(enrolment: DataFrame, samples: DataFrame, cutoff: dt.date) -> DataFrame:
    """Planned sample, enrolled patients and events per site, with the total row.

    The published table is consumed ready-made; its percentage is taken to be patients
    over planned sample, and the total's the ratio of the sums. Rows are cut to the sites
    of ``samples`` first; Spark broadcasts that dimension where its size allows.
    """
    counts = (
        enrolled(enrolment, cutoff)
        .join(samples.select("site"), "site", "left_semi")
        .groupBy("site", "patient_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .groupBy("site")
        .agg(F.count(F.lit(1)).alias("n_patients"), F.sum("events").alias("n_events"))
    )
    rows = samples.join(counts, "site", "left").select(
        F.lit(0).alias("row_ord"),
        "site",
        "n_sample",
        zero(F.col("n_patients")).alias("n_patients"),
        zero(F.col("n_events")).alias("n_events"),
    )
    total = totals_of(rows, ["n_sample", "n_patients", "n_events"]).select(
        F.lit(1).alias("row_ord"), F.lit(TOTAL).alias("site"), "*"
    )
    return rows.unionByName(total).withColumn(
        "pct_patients", share_pct(F.col("n_patients"), F.col("n_sample"))
    )


def site_compliance(status: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Site status as shown: display names, ``n (100%)``, ``n (p%)`` and ``p%``."""
    return status.select(
        "row_ord",
        relabel(F.col("site"), dict(labels)).alias("site"),
        F.concat(number_text(F.col("n_sample")), F.lit(" (100%)")).alias("sample_text"),
        count_pct_text(F.col("n_patients"), F.col("pct_patients")).alias("patients_text"),
        number_text(F.col("n_events")).alias("events_text"),
        pct_text(F.col("pct_patients")).alias("compliance_text"),
    )


def collector_status(enrolment: DataFrame, targets: DataFrame, cutoff: dt.date) -> DataFrame:
    """Target, patients of the last seven days and of all days, per collector with a target.

    The published table is consumed ready-made; patients are counted once per collector
    here. The cumulative percentage divides by one week's target, as published, so it
    can pass 100.
    """
    first, last = reporting_window(cutoff)
    counts = (
        enrolled(enrolment, cutoff)
        .join(targets.select("collector"), "collector", "left_semi")
        .groupBy("collector", "patient_id")
        .agg(F.bool_or(F.col("reg_date").between(F.lit(first), F.lit(last))).alias("recent"))
        .groupBy("collector")
        .agg(
            F.count_if(F.col("recent")).alias("last_week"),
            F.count(F.lit(1)).alias("total"),
        )
    )
    return targets.join(counts, "collector", "left").select(
        "collector",
        "weekly_target",
        zero(F.col("last_week")).alias("last_week"),
        share_pct(zero(F.col("last_week")), F.col("weekly_target")).alias("pct_week"),
        zero(F.col("total")).alias("total"),
        share_pct(zero(F.col("total")), F.col("weekly_target")).alias("pct_total"),
    )


def collector_compliance(
    status: DataFrame, names: DataFrame, threshold: float = COMPLIANCE_THRESHOLD
) -> DataFrame:
    """Collector status with display names, the total row and the below-target flag.

    The total's percentages are ratios of the sums. The flag comes from the number, not
    from the shown text. A collector missing from ``names`` keeps its row without a name.
    """
    shown = status.join(names.select("collector", "display", "site"), "collector", "left")
    columns = [
        "row_ord", "collector", "display", "site", "weekly_target",
        "last_week", "pct_week", "total", "pct_total",
    ]
    detail = shown.withColumn("row_ord", F.lit(0)).select(*columns)
    total = (
        totals_of(status, ["weekly_target", "last_week", "total"])
        .withColumns(
            {
                "row_ord": F.lit(1),
                "collector": F.lit(TOTAL),
                "display": F.lit(TOTAL),
                "site": F.lit(""),
                "pct_week": share_pct(F.col("last_week"), F.col("weekly_target")),
                "pct_total": share_pct(F.col("total"), F.col("weekly_target")),
            }
        )
        .select(*columns)
    )
    # Without a target there is no percentage and nothing to flag.
    below = (F.col("row_ord") == 0) & F.coalesce(F.col("pct_week") < threshold, F.lit(False))
    return detail.unionByName(total).withColumns(
        {
            "pct_week_text": pct_text(F.col("pct_week")),
            "pct_total_text": pct_text(F.col("pct_total")),
            "below_target": below,
        }
    )


def weekly_enrolment(enrolment: DataFrame, targets: DataFrame, cutoff: dt.date) -> DataFrame:
    """Distinct patients per collector and Monday week, only weeks that have any.

    Collectors without a target drop out. ``is_cutoff_week`` compares
    dates; the short label repeats across years.
    """
    counts = (
        enrolled(enrolment, cutoff)
        .groupBy("collector", week_start(F.col("reg_date")).alias("week"))
        .agg(distinct_with_null("patient_id").alias("n_patients"))
    )
    return counts.join(targets, "collector", "inner").select(
        "collector",
        "display",
        "site",
        F.concat_ws("\n", "display", "site").alias("panel_label"),
        "week",
        week_label(F.col("week")).alias("week_label"),
        "n_patients",
        "weekly_target",
        (F.col("week") == F.lit(monday_of(cutoff))).alias("is_cutoff_week"),
    )
