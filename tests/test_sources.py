import datetime as dt

import pytest

from dealtide.sources import schemas, views
from dealtide.sources.sample import sample_tables
from dealtide.sources.tables import catalog_tables, parquet_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return sample_tables(spark, SF_DIR)


@pytest.mark.parametrize("name", schemas.TABLES)
def test_sample_tables_have_the_declared_types(tables, name):
    got = {f.name: f.dataType for f in getattr(tables, name).schema.fields}
    want = {f.name: f.dataType for f in schemas.TABLES[name].fields}
    assert got == want


def test_crm_names_and_text_values(spark):
    raw = spark.createDataFrame(
        [("c1", "p", "n", "Month", "2023-11-30", "bad", "False"), ("c2", None, "n", "Month", None, None, "x")],
        "id string, pse_time_period_c string, name string, pse_time_period_types_c string,"
        " pse_scheduled_utilization_end_date_c string, pse_historical_utilization_end_date_c string,"
        " is_deleted string",
    )
    df = schemas.conform(
        raw,
        schemas.UTILIZATION_CALCULATION,
        schemas.crm_columns("acme")["utilization_calculation"],
    )
    assert df.columns == schemas.UTILIZATION_CALCULATION.names
    first, second = df.collect()
    assert (first.sched_end, first.hist_end, first.is_deleted) == (dt.date(2023, 11, 30), None, False)
    assert second.is_deleted is None


def test_parquet_round_trip(spark, tables, tmp_path):
    tables.opportunity.write.parquet(f"{tmp_path}/opportunity")
    read = parquet_tables(spark, str(tmp_path)).opportunity
    assert sorted(read.collect()) == sorted(tables.opportunity.collect())


def test_catalog_tables_by_crm_name(spark, tables):
    columns = schemas.crm_columns("acme")["opportunity"]
    crm = tables.opportunity.withColumnsRenamed(columns)
    assert "acme_practice_c" in crm.columns
    crm.createOrReplaceGlobalTempView("opportunity")
    read = catalog_tables(spark, "global_temp", "acme").opportunity
    assert sorted(read.collect()) == sorted(tables.opportunity.collect())


def test_every_dashboard_view_can_be_queried(spark, tables):
    found = views.dashboard_views(
        tables, as_of=dt.date(2001, 6, 30), years=(1999, 2000), held_since=1998
    )
    assert len(found) == 7 + 2 * 4
    views.publish(found)
    for name, df in found.items():
        rows = spark.table(name)
        assert rows.columns == df.columns
        assert rows.count() > 0, name


def test_numbers_keep_their_precision(spark):
    raw = spark.createDataFrame([("a", "99999999999.0"), ("b", "0.004"), ("c", "x")], "id string, h string")
    for kind, want in (("string", float), ("double", float), ("decimal(18,6)", None)):
        df = raw.selectExpr("id AS opportunity_id", "cast(NULL AS timestamp_ntz) AS created_date",
                            "'r' AS role", f"try_cast(h AS {kind}) AS hours")
        got = [r.hours for r in schemas.conform(df, schemas.WBS).collect()]
        assert [None if x is None else float(x) for x in got] == [99999999999.0, 0.004, None], (kind, want)


def test_views_written_to_the_catalog(spark, tables, tmp_path):
    spark.sql(f"CREATE DATABASE views_test LOCATION '{tmp_path}/views'")
    try:
        found = views.dashboard_views(tables, as_of=dt.date(2001, 6, 30), years=(), org="data")
        some = {"opp_win_percentage_by_practice": found["opp_win_percentage_by_practice"]}
        views.write_views(some, "views_test")
        views.write_views(some, "views_test")
        read = spark.table("views_test.opp_win_percentage_by_practice")
        assert read.columns == some["opp_win_percentage_by_practice"].columns
        assert read.count() == some["opp_win_percentage_by_practice"].count()
    finally:
        spark.sql("DROP DATABASE views_test CASCADE")


def test_adapters_keep_every_row(spark, tables):
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    people = spark.read.parquet(f"{SF_DIR}/customer.parquet").count()
    assert tables.resource_request_history.count() == items
    assert tables.resource_actuals.count() == 2 * people
    requests = tables.resource_request
    known = requests.join(tables.resource_actuals, "resource_id", "left_semi").count()
    history = tables.resource_request_history.withColumnRenamed("parent_id", "id")
    assert 0 < known < requests.count()  # placeholders occur
    assert requests.join(history, "id", "left_anti").count() > 0  # and requests without history
