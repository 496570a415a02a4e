"""The semantics that would go wrong silently: NULLs, ties, text, totals, dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import classify, dates, stats, text
from cohortlens.operators import care, compare, compliance, distribution, integrity, profile, quantiles, reconcile
from cohortlens.operators.dimensions import dimension_audit
from cohortlens.operators.joins import null_safe_join
from cohortlens.sources.dims import collector_dim, site_samples
from tests.helpers import DAY, admissions, by, one, rows_of, sample_rows


def values(spark, kind, items, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_null_is_one_distinct_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (None, 5)], "a int, b int")
    row = one(df.agg(stats.distinct_with_null("a"), stats.distinct_with_null("a", "b")))
    assert tuple(row) == (3, 3)


def test_null_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 9), ("a", 8)], "k string, w int")
    assert rows_of(null_safe_join(left, right, ["k"], "left_anti")) == [("b", 3)]
    assert len(null_safe_join(left, right, ["k"], "left_semi").collect()) == 2
    assert by(null_safe_join(left, right, ["k"], "left"), "v")[1]["w"] == 9


def test_share_of_zero_is_null_and_ties_go_to_even(spark):
    assert values(spark, "int", [0], lambda x: stats.share_pct(x, F.lit(0))) == [None]
    # 6.25 and 18.75 lie exactly between two tenths.
    assert values(spark, "int", [1, 3], lambda x: stats.share_pct(x, F.lit(16))) == [6.2, 18.8]


def test_number_text(spark):
    assert values(spark, "double", [50.0, 12.5, 0.0, None], text.number_text) == ["50", "12.5", "0", None]
    assert values(spark, "long", [100000, 1234567890], text.number_text) == ["100000", "1234567890"]
    assert values(spark, "long", [1234567], text.thousands) == ["1,234,567"]


def test_cell_text(spark):
    df = spark.createDataFrame([(3, 50.0), (0, 0.0), (0, None)], "n long, p double")
    cells = [r[0] for r in df.select(text.count_pct_text(F.col("n"), F.col("p"))).collect()]
    assert cells == ["3 (50%)", "0 (0%)", "0"]


def test_trim_takes_every_white_space(spark):
    given = ["\t j18  ", "　a b\r\n", "", None]
    assert values(spark, "string", given, text.clean_upper) == ["J18", "A B", "", None]


def test_identifiers_keep_their_digits(spark):
    assert values(spark, "double", [10000000.0, 1234567890123.0], lambda x: text.id_text(x, "double")) == [
        "10000000",
        "1234567890123",
    ]


def test_subgroup_prefix(spark):
    given = ["Grupo 1 - x", "Grupo 10", "Grupo 4", "x Grupo 1", None, "Grupo 3"]
    assert values(spark, "string", given, text.subgroup_prefix) == [
        "Grupo 1", "Grupo 1", None, None, None, "Grupo 3",
    ]


def test_relabel_falls_through(spark):
    assert values(spark, "string", ["a", "b", None], lambda x: text.relabel(x, {"a": "A"})) == ["A", "b", None]
    assert values(spark, "string", ["a"], lambda x: text.relabel(x, {})) == ["a"]


def test_dates_parse_or_are_null(spark):
    given = ["5/1/2024", "05/01/2024 10:00", " 05/01/2024", "31/02/2024", "sin dato", "05/01/24", None]
    day = dt.date(2024, 1, 5)
    assert values(spark, "string", given, dates.parse_dmy) == [day, day, day, None, None, None, None]
    typed = values(spark, "date", [day], lambda x: dates.parse_dmy(x, "date"))
    assert typed == [day]


def test_timestamps_parse_or_are_null(spark):
    given = ["2024-01-05 10:20:30", "2024/1/5 10:20:30", "2024-01-05T10:20:30Z", "2024-01-05",
             "2024-01-05 10:20", "2024-02-30 10:20:30", "x", None, "24-01-05 10:20:30"]
    ts = dt.datetime(2024, 1, 5, 10, 20, 30)
    assert values(spark, "string", given, dates.parse_ymd_hms) == [ts, ts, ts] + [None] * 6
    given = ["2024-01-05 12:20:30+02:00", "2024-01-05 04:50:30 -0530", "2024.01.05 10.20.30", "20240105 102030",
             "20240105102030", "2024-1-5 10-20-30", "2024-01-05 10:20:30z", " 2024-01-05 10:20:30 "]
    assert values(spark, "string", given, dates.parse_ymd_hms) == [ts] * 8


def test_slots_are_whole_numbers_and_unread_values_are_counted(spark):
    from cohortlens.operators.ingest import unread_counts, whole_number

    given = ["12", "12.0", " 7 ", "12.7", "x", None, "99999999999", "-3.00", "12.0000001"]
    assert values(spark, "string", given, whole_number) == [12, 12, 7, None, None, None, None, -3, None]
    assert values(spark, "double", [12.0, 12.7, None, float("nan")], whole_number) == [12, None, None, None]
    df = spark.createDataFrame([(x,) for x in given], "slot string")
    assert [tuple(r) for r in unread_counts(df, {"slot": whole_number(F.col("slot"))}).collect()] == [("slot", 4)]


def test_duplicate_detail_of_more_keys_than_a_group_limit(spark):
    keys = spark.range(3000).selectExpr("id as person_id", "2 + id % 5 as n_old", "0L as n_new")
    got = reconcile.duplicate_detail(keys, 2500).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 2501)) and min(r["n_times"] for r in got) == 2
    assert [r["person_id"] for r in sorted(got, key=lambda r: r["rank"])][:3] == [4, 9, 14]


def test_stay_is_free_of_summer_time(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [(dt.datetime(2024, 3, 9, 12), dt.datetime(2024, 3, 11, 0))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        span = dates.span_micros(F.col("a"), F.col("b"))
        assert one(df.select(dates.micros_to_days(span)))[0] == 1.5
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weeks_start_on_monday(spark):
    given = [dt.date(2024, 1, 21), dt.date(2024, 1, 22), None]
    assert values(spark, "date", given, dates.week_start) == [dt.date(2024, 1, 15), dt.date(2024, 1, 22), None]
    assert dates.monday_of(dt.date(2024, 1, 21)) == dt.date(2024, 1, 15)
    assert dates.reporting_window(dt.date(2024, 1, 21)) == (dt.date(2024, 1, 15), dt.date(2024, 1, 21))
    assert values(spark, "date", [dt.date(2024, 1, 5)], dates.day_text) == ["05/01/2024"]


def test_age_rounds_down(spark):
    births = [dt.date(2019, 1, 6), dt.date(2019, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 2, 6)]
    ages = values(spark, "date", births, lambda x: dates.age_months(x, F.lit(dt.date(2024, 1, 5))))
    assert ages == [59, 60, -1, -2]


def test_duration_classes(spark):
    days = [-5, 0, 30, 31, 60, 61, 90, 91, None]
    assert values(spark, "int", days, classify.duration_class) == [1, 1, 1, 2, 2, 3, 3, 4, None]


def test_long_stay_bins_are_right_closed(spark):
    days = [60, 60.01, 90, 90.5, 120, 180, 365, 365.1]
    rows = [
        {"complexity": "c", "admit_ts": DAY, "discharge_ts": DAY + dt.timedelta(days=d)} for d in days
    ]
    got = {r["stay_range"]: r["n"] for r in profile.long_stay_bins(admissions(spark, rows)).collect()}
    assert got == {"61-90d": 2, "91-120d": 2, "121-180d": 1, "181-365d": 1, ">365d": 1}


def test_presence_states(spark):
    rows = [{"dx": "A"}, {"dx": "B", "snapshot": "new"}, {"dx": "C"}, {"dx": "C", "snapshot": "new"},
            {"dx": "other"}, {"dx": None}]
    got = by(compare.codelist_coverage(admissions(spark, rows), ["A", "B", "C", "D"]), "dx")
    assert {k: v["status"] for k, v in got.items()} == {
        "A": "Solo en old", "B": "Solo en new", "C": "Presente en ambas", "D": "Ausente en ambas",
    }
    coverage = compare.codelist_coverage(admissions(spark, rows), ["A", "B", "C", "D"])
    assert sorted(r["dx"] for r in compare.codelist_problems(coverage).collect()) == ["A", "B", "D"]
    assert rows_of(compare.codelist_common(coverage)) == [("C", 1, 1, 0)]


def test_share_stays_null_for_an_absent_category(spark):
    rows = [{"sex": "F"}, {"sex": "M"}, {"sex": None}, {"sex": "F", "snapshot": "new"}]
    got = by(compare.category_diff_share(admissions(spark, rows), "sex"), "sex")
    assert tuple(got["M"]) == ("M", 1, 0, 33.3, None, -1)
    assert got[None]["pct_old"] == 33.3 and got["F"]["pct_new"] == 100.0


def test_total_adds_up_groups(spark):
    rows = [{"site": s, "patient_id": p, "event_no": e}
            for s, p, e in [("x", "1", "a"), ("x", "2", "a"), ("y", "1", "a"), ("y", "1", "a")]]
    got = by(distribution.site_distribution(sample_rows(spark, rows)), "site")
    assert got["TOTAL"]["patients"] == 3  # patient 1 is in both sites
    assert got["x"]["patients_text"] == "2 (66.7%)" and got["TOTAL"]["patients_text"] == "3"


def test_group_total_shows_its_share_and_absent_sites_stay_absent(spark):
    rows = [{"site": "x", "patient_id": "1", "event_no": "a", "subgroup": "Grupo 2"},
            {"site": "y", "patient_id": "1", "event_no": "a", "subgroup": "Grupo 3"}]
    got = by(distribution.group_counts(sample_rows(spark, rows), "Grupo 2"), "site")
    assert set(got) == {"x", "TOTAL"} and got["TOTAL"]["events_text"] == "1 (100%)"


def test_null_patients_and_events_count_once(spark):
    rows = [{"patient_id": None, "event_no": None}, {"patient_id": None, "event_no": None},
            {"patient_id": "1", "event_no": None}]
    got = by(distribution.site_distribution(sample_rows(spark, rows)), "site")["S"]
    assert (got["patients"], got["events"]) == (2, 2)


def test_missing_duration_has_its_own_column(spark):
    d0 = dt.date(2024, 1, 1)
    ends = [d0, d0 + dt.timedelta(days=45), None]
    rows = [{"event_no": str(i), "subgroup": "Grupo 1", "event_start": d0, "event_end": e}
            for i, e in enumerate(ends)]
    got = by(distribution.duration_distribution(sample_rows(spark, rows), ["Grupo 1"]), "site")
    assert tuple(got["S"])[2:8] == (1, 1, 0, 0, 1, 3)
    assert got["S"]["bin_1_text"] == "1 (33.3%)" and got["S"]["bin_3_text"] == "0 (0%)"
    assert got["S"]["total_text"] == "3" and got["TOTAL"]["total_text"] == "3 (100%)"


def test_sequence_test_can_pass_with_a_gap(spark):
    rows = [{"slot_no": n} for n in (1, 2, 4, None)]
    got = one(integrity.sequence_check(sample_rows(spark, rows)))
    assert got["sequence_ok"] is True and got["n_missing"] == 1
    assert rows_of(integrity.sequence_gaps(sample_rows(spark, rows))) == [("S", 3)]


def test_a_site_without_slots(spark):
    df = sample_rows(spark, [{"patient_id": "1"}, {"patient_id": "2"}])
    quota = one(integrity.quota_check(df))
    assert (quota["unique_patients"], quota["design_quota"], quota["unique_slots"]) == (2, None, 1)
    check = one(integrity.sequence_check(df))
    assert check["sequence_ok"] is None and check["n_missing"] is None
    assert integrity.sequence_gaps(df).isEmpty()
    low = sample_rows(spark, [{"slot_no": 0}, {"slot_no": -3}])
    assert integrity.sequence_gaps(low).isEmpty()
    assert one(integrity.sequence_check(low))["n_missing"] == 0


def test_a_missing_slot_is_one_of_two_slots(spark):
    rows = [{"patient_id": "1", "slot_no": 4}, {"patient_id": "1"}, {"patient_id": "2", "slot_no": 5},
            {"patient_id": None, "slot_no": 6}, {"patient_id": None, "slot_no": 7}]
    got = integrity.multi_slot_patients(sample_rows(spark, rows))
    assert rows_of(got) == rows_of(
        spark.createDataFrame(
            [("S", "1", 4), ("S", "1", None), ("S", None, 6), ("S", None, 7)],
            "a string, b string, c int",
        )
    )


def test_pairs_may_exceed_both_tables(spark):
    key = {"person_type": None, "person_id": "7", "admit_ts": DAY}
    rows = [{**key}] * 3 + [{**key, "snapshot": "new"}] * 2
    rows += [{**key, "person_id": "8"}, {**key, "person_id": "9", "snapshot": "new"}]
    counts = reconcile.event_key_counts(admissions(spark, rows))
    got = {r["metric"]: int(r["value"]) for r in reconcile.snapshot_reconcile(counts).collect()}
    assert got == {"common_persons": 1, "common_events": 6, "events_only_new": 1, "events_only_old": 1}


def test_pair_counts_pass_the_bigint(spark):
    counts = spark.createDataFrame(
        [("a", "1", DAY, 2 * 10**11, 2 * 10**11)],
        "person_type string, person_id string, admit_ts timestamp_ntz, n_old long, n_new long",
    )
    got = {r["metric"]: int(r["value"]) for r in reconcile.snapshot_reconcile(counts).collect()}
    assert got["common_events"] == 4 * 10**22
    assert int(one(reconcile.common_event_keys(counts))["n_pairs"]) == 4 * 10**22


def test_top_duplicates_break_ties_by_key_with_null_last(spark):
    rows = [{"person_id": p, "admit_ts": DAY} for p in ("b", "a", None, "c") for _ in range(2)]
    rows += [{"person_id": "z", "admit_ts": DAY}]
    counts = reconcile.event_key_counts(admissions(spark, rows))
    got = reconcile.duplicate_detail(counts, k=3).orderBy("rank")
    assert [r["person_id"] for r in got.collect()] == ["a", "b", "c"]


def test_dense_histogram_drops_what_is_off_the_spine(spark):
    rows = [{"age_months": a} for a in (0.0, 5.0, 5.0, 5.5, 60.0, -1.0, None, float("nan"))]
    got = by(compare.dense_histogram_diff(admissions(spark, rows)), "age_months")
    assert len(got) == 60 and sum(r["n_old"] for r in got.values()) == 3 and got[5]["n_old"] == 2


def test_enrolment_rules(spark):
    cutoff = dt.date(2024, 1, 21)
    rows = [
        ("1", "a", "s1", dt.date(2024, 1, 21), True),
        ("1", "a", "s1", dt.date(2024, 1, 2), True),
        ("2", "a", "s1", dt.date(2024, 1, 14), True),
        ("3", "a", "s1", dt.date(2024, 1, 22), True),
        ("4", "a", "s1", dt.date(2024, 1, 20), None),
        ("5", "a", "s1", dt.date(2024, 1, 20), False),
        ("6", "x", "s9", dt.date(2024, 1, 20), True),
    ]
    df = spark.createDataFrame(
        rows, "patient_id string, collector string, site string, reg_date date, eligible boolean"
    )
    targets = collector_dim(spark, [("a", "A", "s1", 2), ("b", "B", "s2", 0)])
    status = compliance.collector_status(df, targets, cutoff)
    assert rows_of(status) == [("a", 2, 1, 50.0, 2, 100.0), ("b", 0, 0, None, 0, None)]
    shown = by(compliance.collector_compliance(status, targets.filter("collector = 'a'")), "collector")
    assert shown["a"]["below_target"] and not shown["b"]["below_target"]
    assert shown["b"]["display"] is None and shown["b"]["pct_week_text"] is None
    assert not shown["TOTAL"]["below_target"] and shown["TOTAL"]["pct_week_text"] == "50%"

    weekly = by(compliance.weekly_enrolment(df, targets, cutoff), "week")
    assert {w: r["n_patients"] for w, r in weekly.items()} == {
        dt.date(2024, 1, 1): 1, dt.date(2024, 1, 8): 1, dt.date(2024, 1, 15): 1,
    }
    assert [w for w, r in weekly.items() if r["is_cutoff_week"]] == [dt.date(2024, 1, 15)]

    sites = compliance.site_status(df, site_samples(spark, [("s1", 4), ("s2", 0)]), cutoff)
    got = by(compliance.site_compliance(sites, {"s1": "First"}), "site")
    assert got["First"]["patients_text"] == "2 (50%)" and got["First"]["events_text"] == "3"
    assert got["s2"]["patients_text"] == "0" and got["s2"]["compliance_text"] is None
    assert got["TOTAL"]["compliance_text"] == "50%"


CARE = (
    "submission_id string, event_index int, collector string, site string, birth_date date, "
    "event_start date, event_end date, emergency boolean, general_ward boolean, "
    "intermediate boolean, icu boolean"
)


def test_care_rules(spark):
    d0 = dt.date(2024, 1, 5)
    rows = [
        ("1", 1, "c", "s", dt.date(2024, 1, 6), d0, d0, True, None, None, True),
        ("1", 2, "c", "s", dt.date(2019, 1, 5), d0, d0, None, None, False, None),
        ("2", 1, "c", "s", dt.date(2023, 1, 5), d0, d0, False, False, False, False),
        ("3", 1, "c", "s", None, d0, d0, True, True, None, False),
    ]
    events = spark.createDataFrame(rows, CARE)
    assert [r["submission_id"] for r in care.birth_after_event(events).collect()] == ["1"]
    assert sorted(r["age_months"] for r in care.age_out_of_range(events).collect()) == [-1, 60]
    assert len(care.events_without_care(events).collect()) == 2
    assert rows_of(care.patients_without_care(events)) == [("2", "c", "s", 1, 1)]
    summary = by(care.error_summary(events), "error_type")
    assert {k: r["n_affected"] for k, r in summary.items()} == {
        "birth_after_event": 1, "age_out_of_range": 2, "events_without_care": 2,
        "patients_without_care": 1,
    }
    levels = by(care.max_care_level(events), "site")
    assert levels["s"]["total"] == 2 and levels["s"]["icu_text"] == "1 (50%)"
    assert levels["s"]["emergency_text"] == "0 (0%)" and levels["TOTAL"]["general_ward_n"] == 1


def test_no_errors_status(spark):
    summary = care.error_summary(spark.createDataFrame([], CARE))
    assert {(r["n_affected"], r["status"]) for r in summary.collect()} == {(0, "Sin errores")}


def test_dimension_audit(spark):
    first = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N"), ("d", "D"), ("f", None), ("g", "x"), ("g", "y")], "code string, label string")
    second = spark.createDataFrame([("a", "A"), ("b", "b"), (None, "M"), ("e", "E"), ("g", "y")], "code string, label string")
    got = rows_of(dimension_audit(first, second, "code", "label"))
    assert got == rows_of(
        spark.createDataFrame(
            [("b", "B", True, False), ("b", "b", False, True), (None, "N", True, False), (None, "M", False, True),
             ("d", "D", True, False), ("e", "E", False, True), ("f", None, True, False), ("g", "x", True, False)],
            "a string, b string, c boolean, d boolean",
        )
    )


def test_numeric_profile(spark):
    rows = [{"age_months": a} for a in (1.0, 2.0, 4.0, 100.0, None)]
    got = one(profile.numeric_profile(admissions(spark, rows)))
    assert tuple(got) == ("old", 1.0, 3.0, 26.8, 100.0, 1, 1)


def test_medians_of_far_apart_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    cases = {
        "a": [-1e300, -5.0, -1e-300, 0.0, 2.5, 7.0, 1e18], "b": [1e-9, 1e9], "c": [-inf, -3.0, -2.0, inf, inf],
        None: [4.0, -4.0, 1.0, nan], "d": [2.0**53 + 2 * k for k in range(9)],
    }
    hist = spark.createDataFrame([(g, v, 1) for g, x in cases.items() for v in x], "g string, v double, n long")
    got = {r["g"]: r["median"] for r in quantiles.weighted_median(hist, "g", "v", "n").collect()}
    assert got == {"a": 0.0, "b": (1e-9 + 1e9) / 2, "c": -2.0, None: 2.5, "d": 2.0**53 + 8}


def test_rows_without_a_snapshot_stay_apart(spark):
    rows = [{"snapshot": "", "age_months": 3.0, "admit_ts": DAY, "discharge_ts": DAY}, {"age_months": 5.0}]
    df = admissions(spark, rows).withColumn("snapshot", F.nullif("snapshot", F.lit("")))
    got = by(profile.numeric_profile(df), "snapshot")
    assert (got[None]["median"], got["old"]["median"]) == (3.0, 5.0)
    assert by(profile.stay_stats(df), "snapshot")[None]["median_days"] == 0.0


@pytest.mark.parametrize("kind", ["snapshot_overview", "discharge_quality", "stay_stats"])
def test_profiles_of_one_sided_data(spark, kind):
    rows = [{"admit_ts": DAY, "discharge_ts": None}]
    got = one(getattr(profile, kind)(admissions(spark, rows)))
    assert got["snapshot"] == "old"


def test_one_stray_slot_is_one_gap(spark):
    top = 2_000_000_000
    rows = [{"slot_no": n} for n in (1, 2, 5, 5, None, 1024, 1025, 1030, top)] + [{"site": None, "slot_no": 3}, {"site": "Z", "slot_no": -4}]
    df = sample_rows(spark, rows)
    got = {(r["site"], r["first_missing"], r["last_missing"], r["n_missing"]) for r in integrity.sequence_gap_ranges(df).collect()}
    assert got == {("S", 3, 4, 2), ("S", 6, 1023, 1018), ("S", 1026, 1029, 4), ("S", 1031, top - 1, top - 1031), (None, 1, 2, 2)}
    missing = {r["site"]: r["n_missing"] for r in integrity.sequence_check(df).collect()}
    assert missing == {"S": sum(r[3] for r in got if r[0] == "S"), None: 2, "Z": 0}


def test_events_of_one_side_from_stored_counts(spark, tmp_path):
    rows = [
        {"person_id": p, "person_type": t, "snapshot": s}
        for p, t, s in (("1", "A", "old"), ("1", "A", "old"), ("1", "A", "new"), ("2", None, "old"), ("2", None, "old"), (None, None, "new"), ("3", None, "new"), ("3", None, "old"))
    ]
    df = admissions(spark, rows)
    reconcile.event_key_counts(df).write.parquet(str(tmp_path / "keys"))
    counts = spark.read.parquet(str(tmp_path / "keys"))
    for side in ("old", "new"):
        assert rows_of(reconcile.events_only_in(df, side, key_counts=counts)) == rows_of(reconcile.events_only_in(df, side))
    assert reconcile.events_only_in(df, "old", key_counts=counts).count() == 2
