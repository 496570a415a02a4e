"""Quantile sketches: rank error, merging of stored parts, one shuffle, edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.fixtures import views
from cohortlens.operators import profile, sketches
from tests.helpers import admissions, one, plan_of, rows_of

SF = "/root/testdata/sf0.001"


def rank_error(values, found, rank):
    below, upto = sum(v < found for v in values), sum(v <= found for v in values)
    n = len(values)
    return max(0.0, below / n - rank, rank - upto / n)


def test_a_smaller_error_takes_a_larger_state():
    sizes = [sketches.sketch_size(a) for a in (0.5, 0.05, 0.01, 0.001, 1e-9)]
    assert sizes == sorted(sizes) and sizes[0] == 8 and sizes[-1] == 65535
    for accuracy in (0, 1, -0.1):
        with pytest.raises(ValueError):
            sketches.sketch_size(accuracy)


@pytest.mark.parametrize("accuracy", [0.05, 0.005])
def test_merged_parts_keep_the_rank_error(spark, tmp_path, accuracy):
    r = random.Random(11)
    # a hot part, ties, an ordered part and wide values
    values = [("hot", 7.0)] * 3000 + [("hot", r.random()) for _ in range(2000)] + [("up", float(k)) for k in range(3000)] + [("wide", r.lognormvariate(0, 9)) for _ in range(3000)]
    rows = spark.createDataFrame([("A", p, v) for p, v in values], "g string, part string, x double")
    sketches.value_sketches(rows, ["g", "part"], "x", accuracy).write.parquet(str(tmp_path / "parts"))
    whole = sketches.merged_sketches(spark.read.parquet(str(tmp_path / "parts")), ["g"])
    for rank in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = one(whole.select("n", "low", "high", sketches.sketched_quantile(rank).alias("q")))
        assert got["n"] == len(values) and rank_error([v for _, v in values], got["q"], rank) <= accuracy
        if rank in (0.0, 1.0):
            assert got["q"] == got["low" if rank == 0.0 else "high"]


def test_no_values(spark):
    rows = spark.createDataFrame([("a", None), ("a", float("nan")), (None, 2.0)], "g string, x double")
    got = sketches.value_sketches(rows, ["g"], "x", 0.01)
    found = {r["g"]: r for r in got.select("*", sketches.sketched_quantile(0.5).alias("q")).collect()}
    assert (found["a"]["n"], found["a"]["n_null"], found["a"]["q"]) == (0, 2, None)
    assert (found[None]["n"], found[None]["q"], found[None]["low"]) == (1, 2.0, 2.0)
    assert one(sketches.merged_sketches(got, []).select("n", "n_null", sketches.sketched_quantile(0.5).alias("q"))) == (1, 2, 2.0)
    assert sketches.value_sketches(rows.limit(0), ["g"], "x", 0.01).isEmpty()


def test_profiles_with_a_sketch_differ_in_the_median_alone(spark):
    tagged = views.tagged(spark, SF)
    for operator, column, name in ((profile.numeric_profile, "age_months", "median"), (profile.stay_stats, None, "median_days")):
        exact, near = operator(tagged), operator(tagged, accuracy=0.005)
        assert near.dtypes == exact.dtypes
        assert rows_of(near.drop(name)) == rows_of(exact.drop(name))
    for snapshot, found in profile.numeric_profile(tagged, accuracy=0.005).select("snapshot", "median").collect():
        ages = [r[0] for r in tagged.filter(F.col("snapshot") == snapshot).select("age_months").collect() if r[0] is not None]
        assert rank_error(ages, found, 0.5) <= 0.005


def test_a_sketch_takes_one_shuffle_and_no_weight(spark, tmp_path):
    views.tagged(spark, SF).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for operator in (profile.numeric_profile, profile.stay_stats):
        plan = plan_of(operator(rows, accuracy=0.01))
        assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("FileScan") == 1
        with pytest.raises(ValueError):
            operator(rows, weight="n", accuracy=0.01)


def test_profiles_of_rows_without_values(spark):
    df = admissions(spark, [{"snapshot": "old"}, {"snapshot": "new", "age_months": 3.0}])
    got = {r["snapshot"]: tuple(r)[1:] for r in profile.numeric_profile(df, accuracy=0.01).collect()}
    assert got == {"old": (None, None, None, None, 1, 0), "new": (3.0, 3.0, 3.0, 3.0, 0, 0)}
    assert {tuple(r)[1:] for r in profile.stay_stats(df, accuracy=0.01).collect()} == {(None, None, None, 0, 0)}
