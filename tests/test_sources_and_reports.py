"""Files in, reports out."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.constants import STUDY_CODES
from cohortlens.fixtures import views
from cohortlens.operators import compare, ingest, profile
from cohortlens.plans import sample_report, snapshot_report, weekly_report
from cohortlens.sources import dims, readers, sinks
from cohortlens.sources.schemas import NEW_EXTRACT, OLD_EXTRACT, SAMPLE_SCHEMA, SNAPSHOT_SCHEMA
from tests.helpers import plan_of, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_catalogue_of_drifting_sources(spark, tmp_path, fmt):
    sources = views.sample_sources(spark, SF)
    catalogue = {}
    for label, df in sources.items():
        catalogue[label] = str(tmp_path / label.replace(" ", "_"))
        sinks.write_table(df, catalogue[label], fmt)
    got = ingest.consolidate_sources(spark, catalogue, fmt)
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in SAMPLE_SCHEMA]
    assert rows_of(got) == rows_of(ingest.consolidate(sources))


def test_csv_ids_stay_text(spark, tmp_path):
    path = str(tmp_path / "ids")
    spark.createDataFrame([("0012", "10000000")], "a string, b string").write.option(
        "header", "true"
    ).csv(path)
    assert rows_of(readers.read_table(spark, path, "csv")) == [("0012", "10000000")]


def test_parts_of_a_container(spark, tmp_path):
    a = spark.createDataFrame([("1", 5)], "INGRESO string, EDAD_MESES int")
    b = spark.createDataFrame([("2", "F")], "INGRESO string, SEXO string")
    paths = {"High": str(tmp_path / "a"), "Low": str(tmp_path / "b")}
    a.write.parquet(paths["High"])
    b.write.parquet(paths["Low"])
    got = readers.read_parts(spark, paths, "COMPLEJIDAD")
    assert got.columns == ["COMPLEJIDAD", "INGRESO", "EDAD_MESES", "SEXO"]
    assert rows_of(got) == [("High", "1", 5, None), ("Low", "2", None, "F")]


def test_partitioned_container(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = spark.createDataFrame([("1", "High"), ("2", "Low")], "INGRESO string, COMPLEJIDAD string")
    rows.write.partitionBy("COMPLEJIDAD").parquet(root)
    assert readers.read_part_folder(spark, root).count() == 2
    one = readers.read_named_part(spark, root, "COMPLEJIDAD", "Low")
    assert [r["INGRESO"] for r in one.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(COMPLEJIDAD" in plan_of(one)


def test_saved_frame(spark):
    spark.range(3).createOrReplaceTempView("saved_frame")
    assert readers.read_saved(spark, "saved_frame").count() == 3


def test_harmonised_snapshot_has_the_target_schema(spark):
    df = ingest.tagged_snapshots(
        views.extract(spark, SF, "old"), views.extract(spark, SF, "new"), OLD_EXTRACT, NEW_EXTRACT
    )
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in SNAPSHOT_SCHEMA]


def test_inline_dimensions(spark):
    assert dims.code_spine(spark, STUDY_CODES).count() == len(set(STUDY_CODES)) == 52
    assert [r[0] for r in dims.int_spine(spark, 0, 59, "m").orderBy("m").collect()] == list(range(60))
    assert dims.collector_dim(spark, [("a", "A", "s", None)]).collect()[0]["weekly_target"] is None


def test_sink_orders(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    sinks.write_table(rows, path, order_by=["-x"], headers={"x": "Valor"})
    assert spark.read.parquet(path).columns == ["Valor"]
    files = sorted(str(f) for f in (tmp_path / "out").glob("part-*"))
    assert [r[0] for f in files for r in spark.read.parquet(f).collect()] == [2, 1, None]


def test_staged_table_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    rows = spark.createDataFrame([("",), (None,), ("A",)], "site string")
    with pytest.raises(RuntimeError), sinks.staging(spark) as staged:
        df = staged(rows, "rows")
        assert sorted(df.collect(), key=str) == sorted(rows.collect(), key=str)
        files = [f.removeprefix("file://") for f in df.inputFiles()]
        assert files and all(f.startswith(f"{shared}/cohortlens/") for f in files)
        raise RuntimeError
    assert not any(os.path.exists(f) for f in files)


def test_written_sample_report_keeps_an_empty_site(spark, tmp_path):
    sample = views.sample(spark, SF).limit(40).withColumn(
        "site", F.when(F.col("slot_no") % 3 == 0, "").when(F.col("slot_no") % 3 == 1, F.col("site"))
    )
    events = spark.createDataFrame(sample.collect(), sample.schema)
    paths = sample_report.write_sample_report(events, str(tmp_path))
    want = sample_report.sample_tables(events.distinct())["site_distribution"]
    got = spark.read.parquet(paths["site_distribution"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_snapshot_report(spark, tmp_path):
    tagged = views.tagged(spark, SF, persons=True)
    paths = snapshot_report.write_snapshot_report(tagged, str(tmp_path), codes=views.CODES)
    tables = snapshot_report.snapshot_tables(tagged, views.CODES)
    assert set(paths) == set(tables) and set(snapshot_report.ORDER) <= set(tables)
    for name in ("crossing", "stays", "age", "sex", "overview", "discharge", "duplicates_detail"):
        assert rows_of(spark.read.parquet(paths[name])) == rows_of(tables[name])
    # from counts as from the rows
    assert rows_of(tables["discharge"]) == rows_of(
        profile.indicator_table(profile.discharge_quality(tagged), profile.DISCHARGE_METRICS, "string")
    )
    for name, want in {
        "codes": compare.codelist_coverage(tagged, views.CODES),
        "complexity": compare.category_diff(tagged, "complexity"),
        "sex": compare.category_diff_share(tagged, "sex"),
        "age": profile.indicator_table(profile.numeric_profile(tagged), profile.NUMERIC_METRICS),
        "age_distribution": compare.dense_histogram_diff(tagged),
        "stays": profile.stay_stats(tagged),
        "long_stays": profile.long_stay_bins(tagged),
    }.items():
        assert rows_of(tables[name]) == rows_of(want), name
    shown = {r["indicator"]: r for r in tables["overview"].collect()}
    assert shown["n_rows"]["old"] == f"{tagged.filter("snapshot = 'old'").count():,}"


def test_reports_show_display_names(spark, tmp_path):
    sample = spark.createDataFrame(views.sample(spark, SF).limit(40).collect(), SAMPLE_SCHEMA)
    paths = sample_report.write_sample_report(sample, str(tmp_path / "s"), headers=sample_report.HEADERS)
    shown = spark.read.parquet(paths["duration_group_1"]).columns
    assert {"Centro", "≤ 1 mes", "1 a 2 meses", "2 a 3 meses", "> 3 meses"} <= set(shown)
    assert "site" in spark.read.parquet(paths["group_2"]).columns
    for report in (snapshot_report, weekly_report, sample_report):
        assert all(len(set(names.values())) == len(names) for names in report.HEADERS.values())


def test_sample_report(spark, tmp_path):
    sample = views.sample(spark, SF)
    paths = sample_report.write_sample_report(sample, str(tmp_path))
    tables = sample_report.sample_tables(ingest.unique_events(sample))
    assert set(paths) == set(tables) and set(sample_report.ORDER) <= set(tables)
    for name in ("site_distribution", "duration_group_1", "sequence_gaps", "study_counts"):
        assert rows_of(spark.read.parquet(paths[name])) == rows_of(tables[name])


def test_weekly_report(spark, tmp_path):
    paths = weekly_report.write_weekly_report(
        str(tmp_path),
        enrolment=views.enrolment(spark, SF),
        care_events=views.care_events(spark, SF),
        samples=views.samples(spark),
        targets=views.targets(spark),
        site_labels=views.SITE_LABELS,
        cutoff=dt.date(2024, 1, 21),
        patient_keys=["patient_id"],
        headers={"max_care_level": weekly_report.HEADERS["max_care_level"]},
    )
    levels = spark.read.parquet(paths["max_care_level"]).columns
    assert {"Centro", "Médico", "Total episodios", "Urgencias", "Hosp. general", "C. intermedios", "UCI"} <= set(levels)
    assert set(weekly_report.ORDER) <= set(paths) and len(paths) == 9
    shown = spark.read.parquet(paths["collector_compliance"])
    assert shown.filter("row_ord = 1").count() == 1


def test_many_sources_of_few_schemas_are_few_scans(spark, tmp_path):
    catalogue, want = {}, []
    for k in range(12):
        rows = spark.range(k, k + 3).selectExpr(
            "string(id) as id" if k % 2 else "string(id) as ingreso", "'1' as evento_vsr", "'Grupo 1' as subgrupo",
            "'01/02/2024' as fecha_inicial_evento", "'x' as fecha_final_evento", "'data' as __source",
        )
        catalogue[f"site {k}"] = str(tmp_path / f"a folder {k}")
        rows.coalesce(1).write.parquet(catalogue[f"site {k}"])
        want += [(f"site {k}", str(n)) for n in range(k, k + 3)]
    one_file = next((tmp_path / "a folder 1").glob("part-*.parquet"))
    got = ingest.consolidate_sources(spark, catalogue)
    assert sorted((r["site"], r["patient_id"]) for r in got.collect()) == sorted(want)
    assert plan_of(got).count("FileScan") == 2
    alone = readers.read_by_schema(spark, {"file": str(one_file)})
    assert {r[readers.SOURCE] for r in alone[0].collect()} == {"file"}


def test_losses_are_counted_while_the_report_is_written(spark, tmp_path):
    unread = ingest.Unread()
    sources = views.sample_sources(spark, SF)
    paths = sample_report.write_sample_report(ingest.consolidate(sources, unread), str(tmp_path / "s"), unread=unread)
    got = {(r["source"], r["column"]): r["n_unread"] for r in spark.read.parquet(paths["unread"]).collect()}
    for label, df in sources.items():
        assert got[label, "event_end"] == df.filter("fecha_final_evento = 'sin dato'").count() > 0
        assert got[label, "event_start"] == got[label, "slot_no"] == 0
    assert rows_of(ingest.consolidate(sources, ingest.Unread())) == rows_of(ingest.consolidate(sources))
    with pytest.raises(ValueError):
        ingest.harmonise_sample(sources["ASIA"], F.lit("x"), unread=ingest.Unread())

    unread, extracts = ingest.Unread(), [views.extract(spark, SF, s) for s in ("old", "new")]
    extracts[1] = extracts[1].withColumn("EDAD_MESES", F.lit("old"))
    tagged = ingest.tagged_snapshots(*extracts, unread=unread)
    paths = snapshot_report.write_snapshot_report(tagged, str(tmp_path / "r"), codes=views.CODES, headers=snapshot_report.HEADERS, unread=unread)
    got = {(r["Base"], r["Columna"]): r["Valores no leídos"] for r in spark.read.parquet(paths["unread"]).collect()}
    assert got["new", "age_months"] == extracts[1].count() and got["old", "age_months"] == 0


def test_a_failing_table_leaves_the_old_report(spark, tmp_path):
    root, first = str(tmp_path / "r"), spark.createDataFrame([(1,)], "x int")
    with pytest.raises(FileNotFoundError):
        sinks.read_report(spark, root)
    sinks.write_report({"a": first, "b": first}, root)
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_report({"a": first.selectExpr("x + 1 as x"), "b": broken}, root)
    assert {n: rows_of(df) for n, df in sinks.read_report(spark, root).items()} == {"a": [(1,)], "b": [(1,)]}
    assert len(os.listdir(f"{root}/runs")) == 1
    for k in range(3):
        sinks.write_report({"a": first.selectExpr(f"x + {k + 5} as x")}, root, "csv")
    assert rows_of(sinks.read_report(spark, root)["a"]) == [("8",)] and sinks.report_paths(spark, root).keys() == {"a"}
    assert len(os.listdir(f"{root}/runs")) == len([n for n in os.listdir(f"{root}/manifests") if n.endswith(".json")]) == 2
    assert sinks.write_report({}, root) == {}


def test_every_label_is_read_back(spark, tmp_path):
    tagged = views.tagged(spark, SF, persons=True)
    root = str(tmp_path / "s")
    snapshot_report.write_snapshot_report(tagged, root, codes=views.CODES, headers=snapshot_report.HEADERS, labels=snapshot_report.LABELS)
    shown = sinks.read_report(spark, root)
    assert set(snapshot_report.HEADERS) - {"unread"} == set(shown)
    for name, df in shown.items():
        assert set(snapshot_report.HEADERS[name].values()) <= set(df.columns), name
    for name, columns in snapshot_report.LABELS.items():
        for column, texts in columns.items():
            header = snapshot_report.HEADERS[name][column]
            assert {r[header] for r in shown[name].collect()} == set(texts.values()), name


def test_care_tables_read_the_events_twice(spark, tmp_path):
    path = str(tmp_path / "care")
    views.care_events(spark, SF).write.parquet(path)
    events = spark.read.parquet(path)
    inputs = dict(
        enrolment=views.enrolment(spark, SF), samples=views.samples(spark), targets=views.targets(spark),
        site_labels=views.SITE_LABELS, cutoff=dt.date(2024, 1, 21), patient_keys=["patient_id"],
    )
    source, scans = set(events.inputFiles()), []

    def keep(df, name, partition_by):
        scans.append(plan_of(df, run=False).count("FileScan"))
        return sinks.stored(df, name, partition_by)

    tables = weekly_report.weekly_tables(care_events=events, keep=keep, **inputs)
    assert scans == [1, 1] and not any(source & set(df.inputFiles()) for df in tables.values())
    assert "PartitionFilters: [isnotnull(rule" in plan_of(tables["age_out_of_range"])
    lazy = weekly_report.weekly_tables(care_events=events, **inputs)
    from cohortlens.operators import care

    want = {
        "error_summary": care.error_summary(events, ["patient_id"]), "max_care_level": care.max_care_level(events),
        "patients_without_care": care.patients_without_care(events, ["patient_id"]), "birth_after_event": care.birth_after_event(events),
        "age_out_of_range": care.age_out_of_range(events), "events_without_care": care.events_without_care(events),
    }
    for name, df in want.items():
        assert rows_of(tables[name]) == rows_of(df) == rows_of(lazy[name]), name
        assert tables[name].dtypes == df.dtypes
    paths = weekly_report.write_weekly_report(str(tmp_path / "w"), headers=weekly_report.HEADERS, labels=weekly_report.LABELS, care_events=events, **inputs)
    shown = {r["Tipo de error"] for r in spark.read.parquet(paths["error_summary"]).collect()}
    assert shown == set(weekly_report.LABELS["error_summary"]["error_type"].values())
