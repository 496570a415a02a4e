"""Random small frames against brute force in plain Python."""

from __future__ import annotations

import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import compare, distribution, integrity, profile, reconcile
from cohortlens.operators.quantiles import weighted_median
from tests.helpers import DAY, admissions, by, rows_of, sample_rows

SEEDS = [1, 2, 3]


def random_admissions(rng: random.Random, n: int = 120, hot: float = 0.4) -> list[dict]:
    """Few keys with NULLs among them; one key holds a large part of the rows."""
    rows = []
    for _ in range(n):
        is_hot = rng.random() < hot
        rows.append(
            {
                "snapshot": rng.choice(["old", "new"]),
                "person_type": None if is_hot else rng.choice(["a", "b", None]),
                "person_id": "hot" if is_hot else rng.choice(["1", "2", "3", None]),
                "admit_ts": DAY if is_hot else DAY + dt.timedelta(days=rng.randrange(4)),
                "discharge_ts": rng.choice(
                    [None, DAY + dt.timedelta(microseconds=rng.randrange(-10**10, 10**13))]
                ),
                "age_months": rng.choice([None, float(rng.randrange(90)), rng.random() * 70]),
                "sex": rng.choice(["F", "M", None]),
            }
        )
    return rows


def key(r: dict) -> tuple:
    return r["person_type"], r["person_id"], r["admit_ts"]


@pytest.mark.parametrize("seed", SEEDS)
def test_reconcile(spark, seed):
    rows = random_admissions(random.Random(seed))
    df = admissions(spark, rows)
    old = [r for r in rows if r["snapshot"] == "old"]
    new = [r for r in rows if r["snapshot"] == "new"]
    n_old, n_new = Counter(map(key, old)), Counter(map(key, new))
    counts = reconcile.event_key_counts(df)
    got = {r["metric"]: int(r["value"]) for r in reconcile.snapshot_reconcile(counts).collect()}
    persons = {k[:2] for k in n_old} & {k[:2] for k in n_new}
    assert got == {
        "common_persons": len(persons),
        "common_events": sum(n * n_new[k] for k, n in n_old.items()),
        "events_only_new": sum(n for k, n in n_new.items() if k not in n_old),
        "events_only_old": sum(n for k, n in n_old.items() if k not in n_new),
    }
    matched_new = sum(r["n_new"] for r in reconcile.common_event_keys(counts).collect())
    assert got["events_only_new"] + matched_new == len(new)
    assert reconcile.events_only_in(df, "new").count() == got["events_only_new"]
    assert reconcile.events_only_in(df, "old").count() == got["events_only_old"]
    assert set(map(tuple, reconcile.common_persons(df).collect())) == persons

    profiles = by(reconcile.duplicate_profile(counts), "snapshot")
    for name, seen in (("old", n_old), ("new", n_new)):
        assert tuple(profiles[name])[1:] == (
            sum(seen.values()),
            len(seen),
            sum(n > 1 for n in seen.values()),
            sum(n for n in seen.values() if n > 1),
            max(seen.values()),
        )


@pytest.mark.parametrize("seed", SEEDS)
def test_medians(spark, seed):
    rows = random_admissions(random.Random(seed), n=101)
    df = admissions(spark, rows)
    ages, stays = by(profile.numeric_profile(df), "snapshot"), by(profile.stay_stats(df), "snapshot")
    for name in ("old", "new"):
        mine = [r for r in rows if r["snapshot"] == name]
        known = [r["age_months"] for r in mine if r["age_months"] is not None]
        assert ages[name]["median"] == statistics.median(known)
        assert ages[name]["n_null"] == len(mine) - len(known)
        days = [
            (r["discharge_ts"] - r["admit_ts"]) / dt.timedelta(days=1)
            for r in mine
            if r["discharge_ts"] is not None
        ]
        assert stays[name]["median_days"] == pytest.approx(statistics.median(days), abs=0.051)
        assert stays[name]["n_negative"] == sum(d < 0 for d in days)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 51])
@pytest.mark.parametrize("widths", [[], [10], [1000, 10], [1 << 40, 1 << 20]])
def test_weighted_median(spark, n, widths):
    rng = random.Random(n)
    values = [rng.randrange(-(10**6), 10**6) for _ in range(n)]
    weights = [rng.randrange(1, 5) for _ in range(n)]
    hist = spark.createDataFrame(
        [("g", v, w) for v, w in zip(values, weights)] + [("g", 0, 0), ("none", 5, 0)],
        "g string, v long, n long",
    )
    (row,) = weighted_median(hist, "g", "v", "n", widths).collect()
    everything = [v for v, w in zip(values, weights) for _ in range(w)]
    assert tuple(row) == ("g", statistics.median(everything))


@pytest.mark.parametrize("seed", SEEDS)
def test_histogram_and_categories(spark, seed):
    rows = random_admissions(random.Random(seed))
    df = admissions(spark, rows)
    inside = [
        r for r in rows if r["age_months"] is not None and 0 <= r["age_months"] <= 59
        and r["age_months"] == int(r["age_months"])
    ]
    hist = compare.dense_histogram_diff(df).collect()
    assert sum(r["n_old"] + r["n_new"] for r in hist) == len(inside)
    sexes = by(compare.category_diff(df, "sex"), "sex")
    assert {s: r["n_old"] for s, r in sexes.items() if r["n_old"]} == Counter(
        r["sex"] for r in rows if r["snapshot"] == "old"
    )


def random_sample(rng: random.Random, n: int = 150) -> list[dict]:
    d0 = dt.date(2024, 1, 1)
    return [
        {
            "site": rng.choice(["x", "y", "z"]),
            "patient_id": "hot" if rng.random() < 0.35 else rng.choice(["1", "2", "3", None]),
            "slot_no": rng.choice([None, rng.randrange(-1, 60)]),
            "event_no": rng.choice(["a", "b", None]),
            "subgroup": rng.choice(["Grupo 1", "Grupo 2", None]),
            "event_start": d0,
            "event_end": rng.choice([None, d0 + dt.timedelta(days=rng.randrange(-5, 120))]),
        }
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("block", [1, 7, 1024])
def test_gaps(spark, seed, block):
    rows = random_sample(random.Random(seed))
    used = defaultdict(set)
    for r in rows:
        used[r["site"]].add(r["slot_no"])
    want = {
        (site, i)
        for site, slots in used.items()
        for i in range(1, max((s for s in slots if s is not None), default=0) + 1)
        if i not in slots
    }
    df = sample_rows(spark, rows)
    got = integrity.sequence_gaps(df, block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    missing = {r["site"]: r["n_missing"] for r in integrity.sequence_check(df).collect()}
    assert {s: n for s, n in missing.items() if n} == Counter(s for s, _ in want)


@pytest.mark.parametrize("seed", SEEDS)
def test_double_slots_and_quota(spark, seed):
    rows = random_sample(random.Random(seed))
    df = sample_rows(spark, rows)
    slots, patients = defaultdict(set), defaultdict(set)
    for r in rows:
        slots[r["site"], r["patient_id"]].add(r["slot_no"])
        patients[r["site"]].add(r["patient_id"])
    want = [(*k, s) for k, v in slots.items() if len(v) > 1 for s in v]
    assert rows_of(integrity.multi_slot_patients(df)) == sorted(want, key=repr)
    quota = by(integrity.quota_check(df), "site")
    assert {s: r["unique_patients"] for s, r in quota.items()} == {
        s: len(p) for s, p in patients.items()
    }


@pytest.mark.parametrize("seed", SEEDS)
def test_distribution_totals(spark, seed):
    df = sample_rows(spark, random_sample(random.Random(seed))).distinct()
    table = distribution.duration_distribution(df, ["Grupo 1", "Grupo 2"])
    bins = ["bin_1", "bin_2", "bin_3", "bin_4", "bin_na"]
    assert table.filter(sum(F.col(b) for b in bins) != F.col("total")).isEmpty()
    total = table.filter("row_ord = 1").collect()[0]["total"]
    assert total == df.filter("subgroup is not null").count()
    sites = distribution.site_distribution(df).collect()
    total = next(r for r in sites if r["row_ord"] == 1)
    assert total["patients"] == sum(r["patients"] for r in sites if r["row_ord"] == 0)
    assert total["patients"] >= df.select(F.struct("patient_id")).distinct().count()
