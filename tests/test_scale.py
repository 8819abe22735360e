"""What keeps the plans sound on large and skewed data."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dealtide.operators import staffing
from dealtide.sources.sample import sample_tables
from tests.compare import duckdb_rows, spark_rows

SF_DIR = "/root/testdata/sf0.01"
QUERIES = {name: q for name, q in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = entry.oracle_sql()

# Every join a shuffled one, small partitions, and skew handling that small data can reach.
SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def shuffled(spark):
    before = {key: spark.conf.get(key, None) for key in SHUFFLED}
    for key, value in SHUFFLED.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """A third of the line items on one won deal, a third on one lost deal and one resource."""
    root = tmp_path_factory.mktemp("skewed")
    tables = {
        name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        for name in ("orders", "lineitem", "customer", "part")
    }
    orders = tables["orders"].filter("o_orderkey % 9 <> 0 AND o_custkey % 10 <> 0")
    orders = orders.filter("o_custkey % 16 = 0 AND o_orderkey % 97 <> 0 AND year(o_orderdate) = 1999")
    won = orders.filter("o_orderstatus = 'F'").agg(F.min("o_orderkey")).first()[0]
    lost = orders.filter("o_orderstatus = 'O'").agg(F.min("o_orderkey")).first()[0]
    lot = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber"), F.lit(3))
    key = F.when(lot == 0, F.lit(won)).when(lot == 1, F.lit(lost)).otherwise(F.col("l_orderkey"))
    resource = F.when(lot == 1, F.lit(7).cast("bigint")).otherwise(F.col("l_suppkey"))
    tables["lineitem"] = tables["lineitem"].withColumns({"l_orderkey": key, "l_suppkey": resource})
    for name, df in tables.items():
        df.repartition(4).write.parquet(f"{root}/{name}.parquet")
    return root


HOT = [
    "stage_days_to_close_by_year_for_practice",
    "closedate_changes_per_opp",
    "closedate_movement",
    "wbs_hours_by_practice",
    "wbs_hours_by_role",
    "held_for_lost_by_practice_quarter",
    "resource_request_audit",
    "real_resources",
    "utilization_by_role",
]


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_give_the_same_result(shuffled, skewed_dir, name):
    connection = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "part"):
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{skewed_dir}/{table}.parquet/*.parquet')"
        )
    ours = spark_rows(QUERIES[name](shuffled, skewed_dir))
    assert ours == duckdb_rows(connection, ORACLES[name])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "stage_days_to_close_by_year",
        "closedate_changes_per_opp",
        "closedate_movement",
        "wbs_hours_by_practice",
        "held_for_lost_by_quarter",
    ],
)
def test_rollups_are_hashed_not_sorted_and_read_their_input_once(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    # Only the few columns of deals may be sorted, by id, on their way to the join.
    assert all("key=[id#" in line for line in text.splitlines() if "SortAggregate" in line)
    assert text.count("l_orderkey#") and text.count("/lineitem.parquet") == 1


def test_no_query_runs_python_or_multiplies_rows(spark):
    for name, query in QUERIES.items():
        text = plan(query(spark, SF_DIR))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text, name


@pytest.mark.parametrize(
    "name",
    [
        "stage_days_to_close_by_year_for_practice",
        "closedate_changes_per_opp_for_practice",
        "closedate_movement_for_practice",
        "wbs_hours_for_practice",
        "wbs_hours_by_role",
        "stage_days_by_practice_quarter",
        "held_for_lost_by_role",
    ],
)
def test_narrow_reports_limit_the_history_before_they_fold_it(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    semi = max(i for i, line in enumerate(text.splitlines()) if "LeftSemi" in line)
    folds = [i for i, line in enumerate(text.splitlines()) if "Aggregate" in line and i < semi]
    assert folds  # plans are printed top down


@pytest.mark.parametrize(
    "name",
    [
        "stage_days_by_practice_quarter",
        "stage_days_by_practice_year",
        "win_rate_by_practice_quarter",
        "days_to_close_by_practice_year",
        "utilization_by_practice",
        "utilization_by_practice_quarter",
        "utilization_by_role",
    ],
)
def test_labels_are_given_to_folded_rows(spark, name):
    """Every label rule stands above the aggregation, and the shuffle, of what it labels."""
    lines = plan(QUERIES[name](spark, SF_DIR)).splitlines()
    labels = ("Managed Services", "Senior Technical Consultant")  # the data have neither
    rules = [i for i, line in enumerate(lines) if any(label in line for label in labels)]
    folds = [i for i, line in enumerate(lines) if "Aggregate" in line and "partial" in line]
    assert rules and max(folds) > max(rules)
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert all(any(r < f < s for f in folds) for r in rules for s in scans if s > r)


def test_year_floor_and_window_reach_the_scan(spark, tmp_path):
    from dealtide.operators import dashboard, funnel
    from dealtide.sources.schemas import OPPORTUNITY

    root = tmp_path
    spark.createDataFrame([], OPPORTUNITY).write.parquet(f"{root}/opportunity")
    opps = spark.read.parquet(f"{root}/opportunity")
    text = plan(funnel.win_rate_by_year(opps, min_year=2020))
    assert "GreaterThanOrEqual(created_date,2020-01-01" in text
    assert "EqualTo(is_closed,true)" in text
    columns = text.split("ReadSchema: ")[1].split(">")[0]
    assert columns.count(":") == 4  # created_date, stage_name, is_won, is_closed
    text = plan(dashboard.days_to_close_by_practice_year(opps))
    assert "GreaterThanOrEqual(close_date," in text and "LessThanOrEqual(close_date," in text


def test_profile_does_not_depend_on_row_order(spark):
    rows = [(i % 7, f"v{i % 3}") for i in range(200)]
    random.Random(1).shuffle(rows)
    from dealtide.operators.profiling import table_profile

    one = table_profile(spark.createDataFrame(rows, "a int, b string").coalesce(1)).collect()
    many = table_profile(spark.createDataFrame(rows, "a int, b string").repartition(8)).collect()
    assert one == many


def test_hot_resource_is_split_over_tasks(shuffled):
    from dealtide.operators.staffing import real_resources

    requests = shuffled.range(300_000).selectExpr(
        "cast(id AS string) AS id", "if(id % 3 = 0, 'hot', cast(id AS string)) AS resource_id"
    )
    actuals = shuffled.range(0, 300_000, 2).selectExpr("cast(id AS string) AS resource_id")
    actuals = actuals.union(shuffled.sql("SELECT 'hot'"))
    real = real_resources(requests, actuals)
    rows = real.collect()
    assert len(rows) == 100_000 + 100_000  # every hot one, and the even ones of the others
    assert "SortMergeJoin(skew=true)" in plan(real)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_session_time_zone(spark, zone):
    names = ["stage_days_to_close_by_year", "closedate_movement", "resource_request_audit"]
    before = spark.conf.get("spark.sql.session.timeZone")
    for name in names:
        usual = spark_rows(QUERIES[name](spark, "/root/testdata/sf0.001"))
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert spark_rows(QUERIES[name](spark, "/root/testdata/sf0.001")) == usual
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_numbers_of_a_hot_moment_are_dealt_evenly(spark, monkeypatch):
    from dealtide.plans import numbering

    monkeypatch.setattr(numbering, "CHUNK", 1000)
    # A third in one moment and equal in everything, a third in one hour, one group without times.
    rows = spark.range(60_000).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'hour' ELSE cast(id % 50 as string) END as id",
        """CASE id % 3 WHEN 0 THEN timestamp_ntz '2024-01-01 10:00:00'
           WHEN 1 THEN timestamp_ntz '2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id / 20000)
           WHEN 2 THEN if(id % 50 = 2, NULL, timestamp_ntz '2024-01-01 10:00:00' + make_dt_interval(id % 7)) END as at""",
        "cast(id % 2 as string) as v",
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.numbered(rows, "id", "at", ["v"], "n")
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(r["count"] for r in sizes) < 2.5 * 60_000 / len(sizes)
    got = out.toPandas()
    want = rows.toPandas().sort_values(["id", "at", "v"], na_position="last", kind="stable")
    want["n"] = want.groupby("id").cumcount() + 1
    columns = ["id", "n", "at", "v"]
    assert got.sort_values(["id", "n"])[columns].reset_index(drop=True).equals(
        want.sort_values(["id", "n"])[columns].reset_index(drop=True)
    )


def test_the_audit_is_lazy(spark):
    """Building it runs no job and writes nothing."""
    t = sample_tables(spark, SF_DIR)
    tables = t.resource_request, t.opportunity, t.resource_request_history, t.resource_actuals
    context = spark.sparkContext
    context.setJobGroup("audit", "")
    staffing.resource_request_audit(*tables, min_year=1998)
    assert not context.statusTracker().getJobIdsForGroup("audit")
    context.setJobGroup("others", "")
