import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealtide.functions.labels import STAFF_PRACTICES, staff_practices
from dealtide.operators import profiling, utilization
from tests.frames import at, day, frame


def calculation(id, name="ACS_Historical_Monthly_2023_11", **columns):
    return {
        "id": id,
        "time_period_id": "p",
        "name": name,
        "time_period_type": "Month",
        "sched_end": day("2023-11-30"),
        "hist_end": day("2023-11-30"),
        "is_deleted": False,
    } | columns


def detail(calc_id, **columns):
    return {
        "calc_id": calc_id,
        "resource_id": "r1",
        "role": "Consultant: Data",
        "practice": "Data",
        "target": 80,
        "adj_target": 75,
        "price": 100,
        "billable_hours": 1,
        "calendar_hours": 3,
        "last_modified": at("2023-12-31T23:59:59"),
        "time_period_type": "Month",
        "is_deleted": False,
    } | columns


CALCULATIONS = [
    calculation("c1"),
    calculation("c2", name="ACSxhistorical_Monthly_2023_2"),  # "_" matches any character
    calculation("c3", name="ACS_Scheduled_Monthly_2023_2"),
    calculation("c4", is_deleted=True),
    calculation("c5", time_period_id=None),
    calculation("c6", hist_end=None),
    calculation("c7", time_period_type="Week"),
    calculation("c8", is_deleted=None),
]


@pytest.fixture(scope="module")
def actuals(spark):
    return frame(
        spark,
        "resource_actuals",
        [{"resource_id": "r1", "name": "Zoe - x"}, {"resource_id": "r1", "name": "Ann - y"}],
    )


def master(spark, actuals, details, **parameters):
    return utilization.master_utilization(
        frame(spark, "utilization_calculation", CALCULATIONS),
        frame(spark, "utilization_detail", details),
        actuals,
        year=2023,
        **parameters,
    )


def test_master_filters_and_arithmetic(spark, actuals):
    details = [detail(f"c{i}") for i in range(1, 9)] + [
        detail("c1", resource_id="unknown", calendar_hours=0),
        detail("c1", target=0),
        detail("c1", adj_target=0),
        detail("c1", last_modified=at("2024-01-01T00:00:00")),
        detail("c1", time_period_type="Week"),
        detail("c1", is_deleted=True),
    ]
    rows = master(spark, actuals, details).collect()
    got = [(r.consultant_name, r.month, r.effective_utilization) for r in rows]
    assert [(n, m, None if e is None else float(e)) for n, m, e in got] == [
        ("Ann", "", 33.3),  # this name has no fifth token
        ("Ann", "11", 33.3),
        (None, "11", None),
    ]


def test_house_brand_rule(spark, actuals):
    details = [detail("c1", practice="Acme Field"), detail("c1", practice=None)]
    rules = staff_practices("acme")
    labels = [r.practice for r in master(spark, actuals, details, rules=rules).collect()]
    assert labels == ["acme Services", None]


def test_rollups(spark, actuals):
    details = [
        detail("c1", billable_hours=10, calendar_hours=100),
        detail("c1", billable_hours=21, calendar_hours=100, adj_target=50),
        detail("c1", practice="Network", calendar_hours=0, role="Managing Principle X"),
        detail("c1", practice=None, role="Managing Principal X"),
        detail("c1", practice="Next Gen Data Center", role="Senior Consultant", price=99.5),
    ]
    rows = master(spark, actuals, details)
    by_practice = [tuple(r) for r in utilization.utilization_by_practice(rows).collect()]
    assert by_practice == [
        ("Next Gen Data Center PMs", 44.4, 75.0, 33.3),
        ("Data", 24.8, 62.5, 15.5),
    ]
    by_quarter = utilization.utilization_by_practice_quarter(rows).collect()
    assert [(r.practice, r.quarter, r.average_utilization) for r in by_quarter] == [
        ("Data", "Q4", 15.5),
        ("Network", "Q4", None),
        ("Next Gen Data Center PMs", "Q4", 33.3),
    ]
    by_role = utilization.utilization_by_role(rows).collect()
    assert [(r.resource_roles, r.average_resource_price_usd) for r in by_role] == [
        ("Senior Consultant", 100.0),  # 99.5 rounds up
        ("Consultant", 100.0),
        ("Managing Principal", 100.0),
    ]


def test_fact_join_is_counted_without_being_formed(spark, actuals):
    tables = (
        frame(spark, "utilization_calculation", [calculation("c1"), calculation("c2"), calculation("c3")]),
        frame(
            spark,
            "utilization_detail",
            [detail("c1"), detail("c1"), detail("c1", resource_id="unknown"), detail("c2")],
        ),
        frame(
            spark,
            "utilization_summary",
            [{"calc_id": "c1", "created_date": at(f"2023-01-0{i}T00:00:00")} for i in range(1, 4)],
        ),
        actuals,
    )
    rows = utilization.utilization_fact_join(*tables).collect()
    assert [tuple(r) for r in rows] == [("c1", 3, 3, 12)]
    formed = utilization.utilization_fact_rows(*tables)
    assert formed.count() == 12
    assert utilization.utilization_fact_rows(*tables, limit=5).count() == 5
    assert {
        "util_calc_id", "resource_id", "resource_name", "calc_name", "calc_hist_end", "detail_price",
        "detail_role", "summary_created_date",
    } <= set(formed.columns)


def many_to_many(spark):
    """Calculations with many, one and no details, summaries and names, some rows repeated."""
    calcs = [calculation(f"c{k}") for k in range(6)]
    details = [
        detail(f"c{k % 5}", resource_id=f"r{k % 7}", price=k % 3) for k in range(60) if k % 5 != 3 or k < 10
    ]
    summaries = [
        {"calc_id": f"c{k % 4}", "created_date": at(f"2023-01-{k % 9 + 1:02}T00:00:00")} for k in range(25)
    ]
    people = [{"resource_id": f"r{k % 6}", "name": f"n{k % 4}"} for k in range(20)]
    return (
        frame(spark, "utilization_calculation", calcs).repartition(3),
        frame(spark, "utilization_detail", details).repartition(3),
        frame(spark, "utilization_summary", summaries).repartition(3),
        frame(spark, "resource_actuals", people).repartition(3),
    )


def test_rows_of_the_fact_join_are_those_of_the_plain_join(spark):
    calcs, details, summaries, people = many_to_many(spark)
    rows = utilization.utilization_fact_rows(calcs, details, summaries, people)
    calcs.createOrReplaceTempView("calcs")
    details.createOrReplaceTempView("details")
    summaries.createOrReplaceTempView("summaries")
    people.createOrReplaceTempView("people")
    plain = spark.sql(
        "SELECT c.id, d.resource_id, p.name, c.* EXCEPT (id), d.* EXCEPT (calc_id, resource_id), s.* EXCEPT (calc_id)"
        " FROM calcs c JOIN details d ON c.id = d.calc_id JOIN summaries s ON c.id = s.calc_id"
        " JOIN people p ON d.resource_id = p.resource_id"
    )
    whole = sorted(map(str, (tuple(r) for r in plain.collect())))
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == whole
    assert rows.columns[:3] == ["util_calc_id", "resource_id", "resource_name"]

    def listed(df, *first):
        return df.select(*first, *[c for c in df.columns if c not in first]).collect()

    in_order = []
    for c in sorted(listed(calcs, "id")):
        for d in sorted(r for r in listed(details, "calc_id") if r.calc_id == c.id):
            for name in sorted(p.name for p in people.collect() if p.resource_id == d.resource_id):
                for s in sorted(r for r in listed(summaries, "calc_id") if r.calc_id == c.id):
                    rest = [d[k] for k in details.columns if k not in ("calc_id", "resource_id")]
                    in_order.append((c.id, d.resource_id, name, *c[1:], *rest, *s[1:]))
    assert sorted(map(str, in_order)) == whole
    for limit in (1, 17, 473, len(whole) - 1, 10_000):
        first = utilization.utilization_fact_rows(calcs, details, summaries, people, limit=limit)
        got = sorted(str(tuple(r)) for r in first.collect())
        assert got == sorted(map(str, in_order[:limit])), limit


def test_first_rows_are_chosen_before_they_are_joined(spark):
    text = utilization.utilization_fact_rows(*many_to_many(spark), limit=50)._jdf.queryExecution().executedPlan().toString()
    # Details and summaries are cut to the first of each calculation before their shuffle, with no row formed.
    assert text.count("WindowGroupLimit") >= 4
    lines = text.splitlines()
    formed = next(i for i, line in enumerate(lines) if "_named" in line and "Join" in line)
    below = "\n".join(lines[formed:])
    assert below.count("WindowGroupLimit") >= 4


def test_profile_of_columns(spark):
    table = spark.createDataFrame(
        [(0, 0.0, "x", dt.date(2021, 1, 1)), (0, -0.0, None, None), (5, None, "x", dt.date(2020, 1, 1))],
        "n int, d double, t string, day date",
    )
    rows = profiling.table_profile(table, as_of=dt.date(2021, 1, 31)).collect()
    assert [tuple(r) for r in rows] == [
        ("n", 3, 0, 2, 2, None, None),
        ("d", 3, 1, 2, 1, None, None),
        ("t", 3, 1, None, 1, None, None),
        ("day", 3, 1, None, 2, dt.date(2021, 1, 1), 30),
    ]
    empty = profiling.table_profile(table.limit(0), columns=["n"]).collect()
    assert [tuple(r) for r in empty] == [("n", 0, 0, 0, 0, None, None)]


def test_preview(spark):
    table = spark.range(20)
    assert [r.id for r in profiling.table_preview(table, order_by=["id"]).collect()] == [0, 1, 2, 3, 4]
    assert profiling.table_preview(table, n=3).count() == 3


@pytest.mark.parametrize("kind", ["double", "decimal(18,6)"])
def test_fractions_are_rounded_once(spark, actuals, kind):
    def numbers(table, rows, *names):
        rows = frame(spark, table, rows)
        return rows.withColumns({n: rows[n].cast(kind) for n in names})

    names = ("target", "adj_target", "price", "billable_hours", "calendar_hours")

    def rolled(*rows):
        details = numbers("utilization_detail", [detail("c1", **r) for r in rows], *names)
        calculations = frame(spark, "utilization_calculation", CALCULATIONS)
        master = utilization.master_utilization(calculations, details, actuals, year=2023)
        by = utilization.utilization_by_practice(
            utilization.utilization_rows(calculations, details, year=2023)
        )
        return float(master.first().effective_utilization), tuple(by.first())[1:]

    small = {"billable_hours": 0.0040, "calendar_hours": 0.0080}
    assert rolled(small)[0] == 50.0
    held = {"billable_hours": 75, "calendar_hours": 100}
    assert rolled(held | {"adj_target": 0.7249})[1] == (10346.3, 0.7, 75.0)
    assert rolled(held | {"adj_target": 0.0030})[1] == (2500000.0, 0.0, 75.0)


def test_fan_out_is_a_wide_number(spark):
    calculations = frame(spark, "utilization_calculation", [calculation("c1")])
    details = frame(spark, "utilization_detail", [detail("c1")])
    summaries = frame(spark, "utilization_summary", [{"calc_id": "c1"}])
    people = frame(spark, "resource_actuals", [{"resource_id": "r1", "name": "Zoe - x"}])
    sizes = utilization.utilization_fact_join(calculations, details, summaries, people)
    assert dict(sizes.dtypes)["num_fanout"] == "decimal(38,0)"


def test_rollups_read_no_names_and_push_no_label(spark, tmp_path):
    calculations = frame(spark, "utilization_calculation", CALCULATIONS)
    frame(spark, "utilization_detail", [detail("c1")]).write.parquet(f"{tmp_path}/detail")
    rows = utilization.utilization_rows(
        calculations, spark.read.parquet(f"{tmp_path}/detail"), year=2023
    )
    for df in (
        utilization.utilization_by_practice(rows, rules=STAFF_PRACTICES),
        utilization.utilization_by_practice_quarter(rows, rules=STAFF_PRACTICES),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = next(line for line in plan.splitlines() if "FileScan" in line)
        assert "name" not in pushed.split("ReadSchema")[1]
        assert "IsNotNull(practice)" in pushed
        assert plan.count("Join") <= 2


def test_wide_profile_scans_once(spark, tmp_path):
    wide = spark.range(10).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(60)])
    wide.write.parquet(f"{tmp_path}/wide")
    profile = profiling.table_profile(spark.read.parquet(f"{tmp_path}/wide"))
    assert profile._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [r.distinct_values for r in profile.collect()] == [min(k + 1, 10) for k in range(60)]
    assert profiling.table_profile(wide, columns=[]).collect() == []


def test_profile_tells_values_apart_by_their_type(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        table = spark.sql(
            "SELECT timestamp_seconds(s) AS instant, -0D * (s - 1004247000) AS `a``b.c`, cast(s AS decimal(38,10)) AS wide,"
            " '' AS text, if(s > 1004247000, array(1, NULL), NULL) AS listed, map('k', s) AS m,"
            " named_struct('x', 1) AS part, cast('NaN' AS float) * s AS odd, X'00' AS raw, s > 0 AS flag,"
            " cast(0.000 AS decimal(9,3)) AS nil, timestamp_ntz '2001-10-28 01:30:00' AS local"
            " FROM VALUES (1004247000L), (1004250600L) AS t(s)"
        )
        rows = profiling.table_profile(table, as_of=dt.date(2001, 10, 29)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    day = dt.date(2001, 10, 28)
    assert [tuple(r)[2:] for r in rows] == [
        (0, None, 2, day, 1),  # the repeated hour
        (0, 2, 1, None, None),  # -0.0 and 0.0
        (0, 0, 2, None, None),
        (0, None, 1, None, None),
        (1, None, 1, None, None),
        (0, None, 2, None, None),
        (0, None, 1, None, None),
        (0, 0, 1, None, None),
        (0, None, 1, None, None),
        (0, None, 1, None, None),
        (0, 2, 1, None, None),
        (0, None, 1, day, 1),
    ]


def test_profile_of_many_columns_is_quick_and_shuffles_no_text(spark):
    import time

    wide = spark.range(10).select(
        *[(F.col("id") % (k + 1)).cast(["string", "bigint", "double"][k % 3]).alias(f"c{k}") for k in range(200)]
    )
    profile = profiling.table_profile(wide)
    text = profile._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    profile.collect()
    start = time.perf_counter()
    assert [r.distinct_values for r in profiling.table_profile(wide).collect()] == [min(k + 1, 10) for k in range(200)]
    assert time.perf_counter() - start < 6


def test_duplicate_ids(spark):
    table = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,)], "id string")
    assert [tuple(r) for r in profiling.duplicate_ids(table).collect()] == [("a", 2)]
