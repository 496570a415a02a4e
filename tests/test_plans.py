"""What the plans must and must not contain."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from cohortlens.fixtures import views
from cohortlens.fixtures.registry import QUERIES
from cohortlens.functions.dates import parse_ymd_hms
from cohortlens.operators import compare, distribution, integrity, profile, quantiles, reconcile
from cohortlens.plans import snapshot_report
from tests.helpers import plan_of, rows_of

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "Scan ExistingRDD"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF), run=False)
    assert [word for word in FORBIDDEN if word in plan] == []


@pytest.fixture(scope="module")
def tagged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tagged"))
    views.tagged(spark, SF, persons=True).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sample"))
    views.sample(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scans(plan: str) -> int:
    return plan.count("FileScan parquet")


def test_reconcile_has_no_join_and_one_scan(tagged):
    plan = plan_of(reconcile.snapshot_reconcile(reconcile.event_key_counts(tagged)))
    assert "Join" not in plan and scans(plan) == 1
    assert "partial_count" in plan


def test_duplicates_are_cut_before_the_ranking_shuffle(tagged):
    plan = plan_of(reconcile.duplicate_detail(reconcile.event_key_counts(tagged)))
    assert re.search(r"WindowGroupLimit .*Partial", plan) and scans(plan) == 1


@pytest.mark.parametrize("operator", [profile.numeric_profile, profile.stay_stats])
def test_medians_count_the_rows_once(tagged, operator):
    assert scans(plan_of(operator(tagged))) == 1


def test_shares_reuse_the_counts(tagged):
    plan = plan_of(compare.category_diff_share(tagged, "sex"))
    assert scans(plan) == 1 and "Subquery" in plan and "Join" not in plan


def test_totals_reuse_the_aggregate(sample):
    for table in (
        distribution.site_distribution(sample),
        distribution.duration_distribution(sample.distinct(), ["Grupo 1"]),
    ):
        plan = plan_of(table)
        assert scans(plan) == 1 and "ReusedExchange" in plan


def test_the_snapshot_report_reads_the_rows_four_times(tagged, tmp_path):
    source, plans = set(tagged.inputFiles()), []

    def keep(df, name):
        if source & set(df.inputFiles()):
            plans.append(plan_of(df, run=False))
        df.write.parquet(str(tmp_path / name))
        return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))

    tables = snapshot_report.snapshot_tables(tagged, views.CODES, keep)
    assert sum(map(scans, plans)) == len(plans) == 4
    assert not any(source & set(t.inputFiles()) for t in tables.values())


def test_code_lists_need_no_join_and_clean_a_code_once(spark, tagged):
    raw = tagged.withColumn("dx", F.upper(F.btrim("dx")))
    listed = spark.createDataFrame([(c,) for c in (*views.CODES, None)], "dx string")
    plan = plan_of(compare.codelist_coverage(raw, views.CODES))
    assert "Join" not in plan and plan.count("upper(") == 1 and scans(plan) == 1
    got = compare.codelist_coverage(tagged, listed)
    assert rows_of(got) == rows_of(compare.codelist_coverage(tagged, views.CODES))


def test_gaps_read_the_slots_once(sample):
    plan = plan_of(integrity.sequence_gaps(sample))
    assert scans(plan) == 1
    assert "ReadSchema: struct<site:string,slot_no:int>" in plan


def test_quota_counts_copy_no_rows(sample):
    plan = plan_of(integrity.quota_check(sample))
    assert "Expand" not in plan and "ReadSchema: struct<site:string,slot_no:int>" in plan
    assert "ReadSchema: struct<site:string,patient_id:string>" in plan and scans(plan) == 2


def test_a_median_of_values_far_apart_sorts_few_buckets(spark):
    """The first round's buckets stay few where every value is a magnitude of its own."""
    rows = spark.range(200_000).select(F.pow(F.lit(10.0), F.col("id") % 600 - 300 + F.col("id") / 1e6).alias("v"))
    buckets = rows.select(quantiles.magnitude(F.col("v"), quantiles.MAGNITUDE_BITS[0])).distinct().count()
    assert buckets <= 11_360


def test_scans_are_pruned_and_filters_pushed(spark, tagged):
    plan = plan_of(profile.discharge_quality(tagged))
    assert "ReadSchema: struct<snapshot:string,admit_ts:timestamp_ntz,discharge_ts:timestamp_ntz>" in plan
    plan = plan_of(reconcile.events_only_in(tagged, "new"))
    assert "EqualTo(snapshot,new)" in plan and "EqualTo(snapshot,old)" in plan


def test_persons_are_joined_only_when_asked_for(spark):
    assert "c_custkey" not in plan_of(entry_point.queries()["stay_stats"](spark, SF), run=False)


@pytest.fixture
def small_partitions(spark):
    """Sizes at which a test table has skewed partitions, and no broadcast joins."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "8KB",
        "spark.sql.files.openCostInBytes": "0",
        # A hot partition is split between the map tasks that wrote it, so keep several.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    before = {name: spark.conf.get(name, None) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_hot_key_is_split_over_tasks(spark, tmp_path, small_partitions):
    """One event key holds a third of the rows: the anti join splits it, with whole results."""
    cold = spark.range(6000).select(
        F.lit("new").alias("snapshot"), F.lit("t").alias("person_type"),
        F.col("id").cast("string").alias("person_id"), F.col("id").alias("payload"),
    )
    hot = cold.limit(0).unionByName(
        spark.range(3000).select(
            F.lit("new").alias("snapshot"), F.lit(None).cast("string").alias("person_type"),
            F.lit("hot").alias("person_id"), F.col("id").alias("payload"),
        )
    )
    other = cold.filter("payload % 2 = 0").withColumn("snapshot", F.lit("old"))
    path = str(tmp_path / "rows")
    cold.unionByName(hot).unionByName(other).repartition(12).write.parquet(path)
    rows = spark.read.parquet(path)
    only = reconcile.events_only_in(rows, "new", ["person_type", "person_id"])
    assert "SortMergeJoin(skew=true)" in plan_of(only)
    assert only.count() == 3000 + 3000
    keys = ["person_type", "person_id"]
    reconcile.event_key_counts(rows, keys).write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    once = reconcile.events_only_in(rows, "new", keys, counts)
    plan = plan_of(once)
    assert "SortMergeJoin(skew=true)" in plan and plan.count("n_old") and scans(plan) == 2  # rows and counts
    assert rows_of(once) == rows_of(only)


def test_a_patient_with_many_slots_is_split_over_tasks(spark, tmp_path, small_partitions):
    cold = spark.range(40000).select(
        F.lit("S").alias("site"), F.col("id").cast("string").alias("patient_id"),
        F.col("id").cast("int").alias("slot_no"),
    )
    hot = spark.range(20000).select(
        F.lit("S").alias("site"), F.lit(None).cast("string").alias("patient_id"),
        F.col("id").cast("int").alias("slot_no"),
    )
    path = str(tmp_path / "rows")
    cold.unionByName(hot).repartition(12).write.parquet(path)
    several = integrity.multi_slot_patients(spark.read.parquet(path))
    assert "SortMergeJoin(skew=true)" in plan_of(several)
    assert several.count() == 20000


def test_a_timestamp_is_rewritten_once_for_each_value(spark):
    """One evaluation of the long pattern in the generated code, however often its text is used."""
    df = spark.range(2).select(F.concat(F.lit("2024.01.02 03:04:0"), "id").alias("t")).select(parse_ymd_hms(F.col("t")).alias("ts"))
    code = df._jdf.queryExecution().debug().codegenToSeq().mkString("\n")
    assert code.count("appendReplacement(") == 1
    assert [r.ts for r in df.orderBy("ts").collect()] == [dt.datetime(2024, 1, 2, 3, 4, s) for s in (0, 1)]


def test_text_that_only_looks_rewritten_is_no_timestamp(spark):
    texts = ["=2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05+02:00", "2024-01-02 03:04:05\nx", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_ymd_hms(F.col("t")).alias("ts"))
    assert [r.ts for r in df.collect()] == [None, dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 1, 4, 5), None, None, None]
