"""Empty inputs: every operator still has its columns, totals are 0."""

import datetime as dt

import pytest

from cohortlens.operators import care, compare, compliance, distribution, ingest, integrity, profile, reconcile
from cohortlens.sources.dims import collector_dim, site_samples
from tests.helpers import admissions, sample_rows
from tests.test_semantics import CARE


def test_empty_snapshots(spark):
    df = admissions(spark, [])
    keys = reconcile.event_key_counts(df)
    for empty in (
        profile.snapshot_overview(df), profile.discharge_quality(df), profile.numeric_profile(df),
        profile.stay_stats(df), profile.long_stay_bins(df), compare.category_diff_share(df, "sex"),
        reconcile.duplicate_profile(keys), reconcile.duplicate_detail(keys),
        reconcile.common_persons(df), reconcile.events_only_in(df, "new"),
    ):
        assert empty.isEmpty()
    assert {int(r["value"]) for r in reconcile.snapshot_reconcile(keys).collect()} == {0}
    assert {r["n_old"] + r["n_new"] for r in compare.dense_histogram_diff(df).collect()} == {0}
    assert {r["status"] for r in compare.codelist_coverage(df).collect()} == {"Ausente en ambas"}
    indicators = profile.indicator_table(profile.numeric_profile(df), profile.NUMERIC_METRICS)
    assert [tuple(r)[1:] for r in indicators.collect()] == [(None, None)] * 4 + [(0.0, 0.0)] * 2
    overview = profile.indicator_table(
        profile.snapshot_overview(admissions(spark, [{}])), profile.OVERVIEW_METRICS, "string"
    )
    assert [tuple(r) for r in overview.collect()] == [
        ("n_rows", "1", "0"), ("min_admit", None, None), ("max_admit", None, None),
        ("null_discharge", "1", "0"),
    ]


def test_empty_samples(spark):
    df = sample_rows(spark, [])
    for empty in (
        integrity.quota_check(df), integrity.sequence_check(df), integrity.sequence_gaps(df),
        integrity.multi_slot_patients(df), integrity.site_by_subgroup(df),
    ):
        assert empty.isEmpty()
    assert {r["value"] for r in integrity.study_counts(df).collect()} == {0}
    (total,) = distribution.site_distribution(df).collect()
    assert (total["site"], total["patients"], total["patients_text"]) == ("TOTAL", 0, "0")
    (total,) = distribution.group_counts(df, "Grupo 1").collect()
    assert total["events_text"] == "0"
    (total,) = distribution.duration_distribution(df, ["Grupo 1"]).collect()
    assert (total["total"], total["bin_1_text"], total["total_text"]) == (0, "0", "0")


def test_empty_enrolment_and_care(spark):
    enrolment = spark.createDataFrame(
        [], "patient_id string, collector string, site string, reg_date date, eligible boolean"
    )
    cutoff = dt.date(2024, 1, 21)
    targets = collector_dim(spark, [("a", "A", "s", 5)])
    (row,) = compliance.collector_status(enrolment, targets, cutoff).collect()
    assert tuple(row) == ("a", 5, 0, 0.0, 0, 0.0)
    sites = compliance.site_status(enrolment, site_samples(spark, [("s", 5)]), cutoff)
    assert len(sites.collect()) == 2
    assert compliance.weekly_enrolment(enrolment, targets, cutoff).isEmpty()
    (total,) = care.max_care_level(spark.createDataFrame([], CARE)).collect()
    assert total["total"] == 0 and total["icu_text"] == "0"


def test_sample_without_a_key_column(spark):
    raw = spark.createDataFrame([("e",)], "evento_vsr string")
    with pytest.raises(ValueError, match="patient_id"):
        ingest.harmonise_sample(raw, "S")


def test_site_label_wins_over_a_site_column(spark):
    raw = spark.createDataFrame(
        [(1, "e", "Grupo 1", "1/2/2024", "x", "other")],
        "ingreso long, evento_vsr string, subgrupo string, fecha_inicial_evento string, "
        "fecha_final_evento string, site string",
    )
    (row,) = ingest.harmonise_sample(raw, "S").collect()
    assert tuple(row) == ("S", "1", None, "e", "Grupo 1", None, dt.date(2024, 2, 1), None)


def test_an_event_with_two_dates_stays_two_rows(spark):
    d = dt.date(2024, 1, 1)
    rows = [{"patient_id": "1", "event_no": "a", "event_start": d}] * 2
    rows += [{"patient_id": "1", "event_no": "a", "event_start": dt.date(2024, 1, 2)}]
    events = ingest.unique_events(sample_rows(spark, rows))
    assert events.count() == 2
    assert {r["metric"]: r["value"] for r in integrity.study_counts(events).collect()} == {
        "unique_events": 2, "site_patients": 1, "patients": 1, "patient_events": 1,
    }
