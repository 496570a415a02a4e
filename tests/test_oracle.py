"""Every registered query against its SQL counterpart, row by row and type by type."""

import pytest

import __spark_entry__ as entry_point
from cohortlens.fixtures.oracle import ORACLE
from cohortlens.fixtures.registry import QUERIES
from tests.compare import connect, differences, type_differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry_point.queries())
    assert all(entry_point.oracle_sql()[name] == sql for name, sql in ORACLE.items())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    sql = ORACLE[name]
    df = QUERIES[name](spark, SF)
    assert type_differences(df, con, sql) == {}
    assert differences(df, con, sql) == {}


def test_entry(spark):
    assert entry_point.entry(spark).count() == 4


def test_consolidated_sources_equal_the_single_pass_view(spark):
    from cohortlens.fixtures import views
    from cohortlens.operators.ingest import consolidate

    drifting = consolidate(views.sample_sources(spark, SF))
    single = views.sample(spark, SF)
    assert drifting.exceptAll(single).isEmpty() and single.exceptAll(drifting).isEmpty()


def test_harmonised_extracts_equal_the_single_pass_view(spark):
    from cohortlens.fixtures import views
    from cohortlens.operators.ingest import tagged_snapshots

    arrived = tagged_snapshots(views.extract(spark, SF, "old"), views.extract(spark, SF, "new"))
    single = views.tagged(spark, SF, persons=True)
    assert arrived.exceptAll(single).isEmpty() and single.exceptAll(arrived).isEmpty()


def test_every_line_and_customer_is_read(spark):
    from cohortlens.fixtures import views

    lines = views.tagged(spark, SF).select("admission_id").distinct().count()
    assert lines == views.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber").distinct().count()
    first, second = views.code_dimensions(spark, SF)
    codes = first.select("code").union(second.select("code")).distinct().count()
    assert codes == views.table(spark, SF, "customer").count()
