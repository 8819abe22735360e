"""Lasting views and the sweep over a catalog."""

import datetime as dt

import pytest

from dealtide.operators.profiling import (
    _FOOTERS,
    catalog_profile,
    footer_facts,
    scanned_facts,
    table_profile,
)
from dealtide.sources import schemas, views
from dealtide.sources.lasting import create_views
from dealtide.sources.sample import sample_tables
from dealtide.sources.tables import catalog_tables

SF_DIR = "/root/testdata/sf0.001"
AS_OF = dt.date(2001, 6, 30)
OPTIONS = {"as_of": AS_OF, "years": (1999,), "held_since": 1998}


@pytest.fixture(scope="module")
def crm(spark, tmp_path_factory):
    """The base tables under their CRM names, and an empty namespace for views."""
    root = tmp_path_factory.mktemp("catalog")
    spark.sql(f"CREATE DATABASE crm_test LOCATION '{root}/crm'")
    spark.sql(f"CREATE DATABASE shown_test LOCATION '{root}/shown'")
    columns = schemas.crm_columns("acme")
    tables = sample_tables(spark, SF_DIR)
    for name in schemas.TABLES:
        df = getattr(tables, name).withColumnsRenamed(columns.get(name, {}))
        df.write.saveAsTable(f"crm_test.{schemas.CRM_TABLES[name]}")
    yield "crm_test"
    spark.sql("DROP DATABASE shown_test CASCADE")
    spark.sql("DROP DATABASE crm_test CASCADE")


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_lasting_views_equal_the_operators_and_follow_their_tables(spark, crm):
    made = create_views(spark, crm, "shown_test", "acme", **OPTIONS)
    later = spark.newSession()
    assert set(made) == {r.viewName for r in later.sql("SHOW VIEWS IN shown_test").collect()}

    def compare():
        want = views.dashboard_views(catalog_tables(later, crm, "acme"), org="acme", **OPTIONS)
        assert set(want) == {name for name in made if not name.startswith("base_")}
        for name, df in want.items():
            got = later.table(f"shown_test.{name}")
            assert got.columns == df.columns, name
            rows = sorted_rows(got)
            assert rows == sorted_rows(df) and rows, name
        return {name: sorted_rows(later.table(f"shown_test.{name}")) for name in want}

    before = compare()
    # Deals come in after the views were made, listed a second time, and so do details.
    opportunity = spark.table(f"{crm}.opportunity")
    more = opportunity.filter("is_won AND close_date > '1999-01-01'").limit(60).collect()
    spark.createDataFrame(more, opportunity.schema).write.insertInto(f"{crm}.opportunity")
    detail = spark.table(f"{crm}.pse_utilization_detail_c")
    more = detail.filter("year(last_modified_date) = 1999 AND resource_role_c LIKE 'Engineer%'").limit(50).collect()
    spark.createDataFrame(more, detail.schema).write.insertInto(f"{crm}.pse_utilization_detail_c")
    # A session that has read a table before knows it has changed.
    for table in ("opportunity", "pse_utilization_detail_c"):
        later.catalog.refreshTable(f"{crm}.{table}")
    after = compare()
    for name in ("opp_win_percentage_by_practice", "opps_wbs_hours_and_win_rate", "average_utilization_per_practice_1999"):
        assert before[name] != after[name], name


def test_views_of_the_day_and_columns_by_position(spark, crm):
    create_views(spark, crm, "shown_test", "acme", years=(2000,), staff_rules=(("Ours", ("%o'x\\%", "%data%")),))
    text = spark.sql("SHOW CREATE TABLE shown_test.opps_w_wbs").first()[0]
    assert "current_date()" in text
    labels = {r.practice for r in spark.table("shown_test.master_utilization_2000").collect()}
    assert "Ours" in labels and "Data" not in labels
    assert spark.table("shown_test.opp_win_percentage_by_practice").columns[0] == "practice"
    assert spark.table("shown_test.opps_w_wbs").collect() == []  # the data are old


@pytest.fixture
def folder(spark, tmp_path):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    orders.limit(0).write.parquet(f"{tmp_path}/nothing")
    spark.range(20).selectExpr(
        "id", "cast(NULL AS string) AS note", "0 AS held", "cast(0 AS decimal(10,2)) AS cost",
        "date_add(date '1997-06-20', cast(id AS int)) AS `the ``day`",
        "array(id) AS listed", "if(id < 5, NULL, 0L) AS few", "map('a', id) AS m", "cast(NULL AS int) AS none",
        "cast(NULL AS date) AS never", "cast(NULL AS timestamp) AS nowhen",
    ).repartition(3).write.parquet(f"{tmp_path}/old")
    (tmp_path / "_ignored").mkdir()
    return str(tmp_path)


def test_catalog_profile(spark, folder):
    got = {(r.table, r.column): r for r in catalog_profile(spark, folder, as_of=AS_OF).collect()}
    facts = {k[1]: (r.rows, r.nulls, r.zeros_only, r.newest, r.verdict) for k, r in got.items() if k[0] == "old"}
    day = dt.date(1997, 7, 9)
    assert facts == {
        "id": (20, 0, False, None, "stale"),
        "note": (20, 20, None, None, "all null"),
        "held": (20, 0, True, None, "zeros only"),
        "cost": (20, 0, True, None, "zeros only"),
        "the `day": (20, 0, None, day, "stale"),
        "listed": (20, None, None, None, "stale"),
        "few": (20, 5, True, None, "zeros only"),
        "m": (20, None, None, None, "stale"),
        "none": (20, 20, None, None, "all null"),
        "never": (20, 20, None, None, "all null"),
        "nowhen": (20, 20, None, None, "all null"),
    }
    assert {r.verdict for k, r in got.items() if k[0] == "nothing"} == {"empty"}
    # Every count and date is that of a scan.
    for r in table_profile(spark.read.parquet(f"{folder}/orders.parquet"), as_of=AS_OF).collect():
        seen = got["orders", r.column]
        assert (seen.rows, seen.nulls, seen.newest) == (r.rows, r.nulls, r.max_date)
        assert seen.days_since == r.days_since_max and seen.verdict == "data"
    assert catalog_profile(spark, {}).collect() == []


def test_counts_are_read_from_footers(spark, folder):
    """No data column is read for counts and dates; times and decimals are read alone."""
    session = spark.newSession()
    for key, value in _FOOTERS.items():
        session.conf.set(key, value)
    for name, read in (("old", ["cost:decimal(10,2)", "nowhen:timestamp"]), ("orders.parquet", ["o_orderdate:timestamp_ntz"])):
        table = session.read.parquet(f"{folder}/{name}")
        [scan] = [x for x in plan(footer_facts(table)).splitlines() if "BatchScan" in x]
        assert "COUNT(*)" in scan.split("PushedAggregation:")[1].split("]")[0]
        [scan] = [x for x in plan(scanned_facts(table)).splitlines() if "BatchScan" in x]
        assert scan.split("ReadSchema: struct<")[1].split(">")[0].split(",") == ",".join(read).split(",")
    assert scanned_facts(spark.range(3)) is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_without_statistics_are_scanned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"a": [0, 0, None], "d": [dt.date(2001, 6, 1), None, None]})
    (tmp_path / "bare").mkdir()
    pq.write_table(table, tmp_path / "bare" / "x.parquet", write_statistics=False)
    rows = catalog_profile(spark, str(tmp_path), as_of=AS_OF).collect()
    assert [(r.rows, r.nulls, r.zeros_only, r.newest, r.verdict) for r in rows] == [
        (3, 1, True, None, "zeros only"),
        (3, 2, None, dt.date(2001, 6, 1), "data"),
    ]
