"""Every operator bound to the supplied tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SUBGROUPS
from ..operators import (
    care, compare, compliance, distribution, ingest, integrity, profile, reconcile, sketches,
)
from ..operators.dimensions import dimension_audit
from ..plans import snapshot_report
from ..sources import readers, sinks
from . import views

Query = Callable[[SparkSession, str], DataFrame]
GROUP_1, GROUP_2, GROUP_3 = SUBGROUPS


def _on_tagged(fn: Callable[[DataFrame], DataFrame], persons: bool = False) -> Query:
    return lambda spark, sf: fn(views.tagged(spark, sf, persons))


def _on_keys(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(reconcile.event_key_counts(views.tagged(spark, sf, persons=True)))


def _on_coverage(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_tagged(lambda df: fn(compare.codelist_coverage(df, views.CODES)))


def _on_sample(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(views.sample(spark, sf))


def _on_events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(ingest.unique_events(views.sample(spark, sf)))


def _on_care(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(views.care_events(spark, sf))


def _original(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: fn(ingest.with_original_subgroup(df))


def _as_bigint(column: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The exact decimal as a bigint, as the check compares it; one beyond it fails the query."""
    return lambda df: fn(df).withColumn(column, F.col(column).cast("bigint"))


def _site_status(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.site_status(views.enrolment(spark, sf), views.samples(spark), views.CUTOFF)


def _collector_status(spark: SparkSession, sf: str) -> DataFrame:
    return compliance.collector_status(
        views.enrolment(spark, sf), views.targets(spark), views.CUTOFF
    )


def _only_new_by_stored_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.tagged(spark, sf, persons=True)
    counts = sinks.stored(reconcile.event_key_counts(rows), "event-keys")
    return reconcile.events_only_in(rows, "new", key_counts=counts)


def _sketched_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Medians from stored sketches of parts, and whether their ranks are within the error."""
    accuracy = 0.005
    rows = views.tagged(spark, sf)
    parts = sketches.value_sketches(rows, ["snapshot", "complexity"], "age_months", accuracy)
    whole = sketches.merged_sketches(sinks.stored(parts, "sketches"), ["snapshot"])
    found = whole.withColumn("median", sketches.sketched_quantile(0.5)).drop("sketch")
    counts = profile.age_counts(rows).filter("age_months is not null")
    below = F.sum(F.when(F.col("age_months") < F.col("median"), F.col("counted")).otherwise(0))
    upto = F.sum(F.when(F.col("age_months") <= F.col("median"), F.col("counted")).otherwise(0))
    ages = counts.select("snapshot", "age_months", F.col("n").alias("counted"))
    columns = ["snapshot", "n", "n_null", "low", "high"]
    return (
        ages.join(found, "snapshot")
        .groupBy(*columns)
        .agg(below.alias("below"), upto.alias("upto"))
        .select(
            *columns,
            F.col("below").between(0, F.col("n") * (0.5 + accuracy)).alias("not_above"),
            (F.col("upto") >= F.col("n") * (0.5 - accuracy)).alias("not_below"),
        )
    )


def _unread(spark: SparkSession, sf: str) -> DataFrame:
    """What the sources lose, counted in the pass that stores the consolidated sample."""
    unread = ingest.Unread()
    sinks.stored(ingest.consolidate(views.sample_sources(spark, sf), unread), "sample")
    return unread.counts(spark)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


def _container(spark: SparkSession, sf: str) -> str:
    """A container on disk: one part for each priority."""
    parts = sinks.stored(_orders(spark, sf), "container", ["o_orderpriority"])
    return parts.inputFiles()[0].rsplit("/", 2)[0]


def _labelled_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Two parts with different columns, each a path of its own."""
    kept = {"open": _orders(spark, sf).filter("o_orderkey % 2 = 0").drop("o_totalprice")}
    kept["closed"] = _orders(spark, sf).filter("o_orderkey % 2 = 1").drop("o_orderpriority")
    paths = {k: sinks.stored(df, k).inputFiles()[0].rsplit("/", 1)[0] for k, df in kept.items()}
    return readers.read_parts(spark, paths, "part")


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    """A frame computed once, saved in the catalogue and loaded by its name."""
    name = f"daily_{uuid.uuid4().hex}"
    by_day = _orders(spark, sf).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sinks.stored(by_day, "saved").createOrReplaceTempView(name)
    return readers.read_saved(spark, name)


def _sources_by_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The drifting sources written out and read by their schemas, not one by one."""
    catalogue = {
        label: sinks.stored(df, "source").inputFiles()[0].rsplit("/", 1)[0]
        for label, df in views.sample_sources(spark, sf).items()
    }
    return ingest.consolidate_sources(spark, catalogue)


def _written_report(spark: SparkSession, sf: str) -> DataFrame:
    """A table of a report as readers find it, with its labels and headers."""
    root = f"{sinks.shared_folder(spark)}/cohortlens/report-{uuid.uuid4().hex}"
    quality = profile.discharge_quality(views.tagged(spark, sf))
    table = profile.indicator_table(quality, profile.DISCHARGE_METRICS, "string")
    sinks.write_report(
        {"discharge": table}, root, headers=snapshot_report.HEADERS, labels=snapshot_report.LABELS
    )
    return sinks.read_report(spark, root)["discharge"]


QUERIES: dict[str, Query] = {
    # Sources and harmonisation
    "read_parts": _labelled_parts,
    "read_part_folder": lambda s, sf: readers.read_part_folder(s, _container(s, sf)),
    "read_named_part": lambda s, sf: readers.read_named_part(
        s, _container(s, sf), "o_orderpriority", "5-LOW"
    ),
    "read_saved": _saved,
    "sources_by_schema": _sources_by_schema,
    "unread_values": _unread,
    "written_report": _written_report,
    "consolidate_sources": lambda s, sf: ingest.consolidate(views.sample_sources(s, sf)),
    "harmonise_snapshot": lambda s, sf: ingest.tagged_snapshots(
        views.extract(s, sf, "old"), views.extract(s, sf, "new")
    ),
    "unique_events": _on_events(lambda df: df),
    # Snapshot profiles
    "snapshot_overview": _on_tagged(profile.snapshot_overview),
    "snapshot_overview_indicators": _on_tagged(
        lambda df: profile.indicator_table(
            profile.snapshot_overview(df), profile.OVERVIEW_METRICS, "string"
        )
    ),
    "shown_overview": _on_tagged(
        lambda df: snapshot_report.shown_overview(
            profile.indicator_table(
                profile.snapshot_overview(df), profile.OVERVIEW_METRICS, "string"
            )
        )
    ),
    "sketched_ages": _sketched_ages,
    "numeric_profile": _on_tagged(profile.numeric_profile),
    "numeric_profile_indicators": _on_tagged(
        lambda df: profile.indicator_table(profile.numeric_profile(df), profile.NUMERIC_METRICS)
    ),
    "discharge_quality": _on_tagged(profile.discharge_quality),
    "discharge_quality_indicators": _on_tagged(
        lambda df: profile.indicator_table(
            profile.discharge_quality(df), profile.DISCHARGE_METRICS, "string"
        )
    ),
    "stay_stats": _on_tagged(profile.stay_stats),
    "long_stay_bins": _on_tagged(profile.long_stay_bins),
    # Snapshot comparison
    "category_diff": _on_tagged(lambda df: compare.category_diff(df, "complexity")),
    "category_diff_share": _on_tagged(lambda df: compare.category_diff_share(df, "sex")),
    "category_diff_share_complexity": _on_tagged(
        lambda df: compare.category_diff_share(df, "complexity")
    ),
    "dense_histogram_diff": _on_tagged(compare.dense_histogram_diff),
    "codelist_coverage": _on_coverage(lambda df: df),
    "codelist_status_summary": _on_coverage(compare.codelist_status_summary),
    "codelist_problems": _on_coverage(compare.codelist_problems),
    "codelist_common": _on_coverage(compare.codelist_common),
    # Duplicates and reconciliation
    "duplicate_profile": _on_keys(reconcile.duplicate_profile),
    "duplicated_keys": _on_keys(reconcile.duplicated_keys),
    "duplicate_detail": _on_keys(reconcile.duplicate_detail),
    "snapshot_reconcile": _on_keys(_as_bigint("value", reconcile.snapshot_reconcile)),
    "common_persons": _on_tagged(reconcile.common_persons, persons=True),
    "common_event_keys": _on_keys(_as_bigint("n_pairs", reconcile.common_event_keys)),
    "events_only_in_new": _on_tagged(lambda df: reconcile.events_only_in(df, "new"), persons=True),
    "events_only_in_old": _on_tagged(lambda df: reconcile.events_only_in(df, "old"), persons=True),
    "events_only_new_by_stored_counts": _only_new_by_stored_counts,
    # Sample integrity
    "study_counts": _on_events(integrity.study_counts),
    "subgroup_counts": _on_events(integrity.subgroup_counts),
    "site_by_subgroup": _on_events(integrity.site_by_subgroup),
    "quota_check": _on_sample(integrity.quota_check),
    "sequence_check": _on_sample(integrity.sequence_check),
    "sequence_gap_ranges": _on_sample(integrity.sequence_gap_ranges),
    "sequence_gaps": _on_sample(integrity.sequence_gaps),
    "multi_slot_patients": _on_sample(integrity.multi_slot_patients),
    # Distribution tables
    "site_distribution": _on_sample(distribution.site_distribution),
    "group_counts_1_original": _on_sample(
        _original(lambda df: distribution.group_counts(df, GROUP_1))
    ),
    "group_counts_2": _on_sample(lambda df: distribution.group_counts(df, GROUP_2)),
    "group_counts_3": _on_sample(lambda df: distribution.group_counts(df, GROUP_3)),
    "duration_distribution": _on_events(
        lambda df: distribution.duration_distribution(df, [GROUP_1])
    ),
    "duration_distribution_original": _on_events(
        _original(lambda df: distribution.duration_distribution(df, [GROUP_1]))
    ),
    # Enrolment and compliance
    "site_status": _site_status,
    "site_compliance": lambda s, sf: compliance.site_compliance(
        _site_status(s, sf), views.SITE_LABELS
    ),
    "collector_status": _collector_status,
    "collector_compliance": lambda s, sf: compliance.collector_compliance(
        _collector_status(s, sf), views.targets(s)
    ),
    "weekly_enrolment": lambda s, sf: compliance.weekly_enrolment(
        views.enrolment(s, sf), views.targets(s), views.CUTOFF
    ),
    # Care events
    "care_findings": _on_care(care.findings),
    "error_summary_from_counts": _on_care(
        lambda df: care.error_summary(
            care.care_counts(df, ["patient_id"]), ["patient_id"], counted=True
        )
    ),
    "birth_after_event": _on_care(care.birth_after_event),
    "age_out_of_range": _on_care(care.age_out_of_range),
    "events_without_care": _on_care(care.events_without_care),
    "patients_without_care": _on_care(
        lambda df: care.patients_without_care(df, ["patient_id"])
    ),
    "error_summary": _on_care(lambda df: care.error_summary(df, ["patient_id"])),
    "max_care_level": _on_care(care.max_care_level),
    # Dimensions
    "dimension_audit": lambda s, sf: dimension_audit(
        *views.code_dimensions(s, sf), "code", "label"
    ),
}
