"""Sums and ratios of numbers of any type against Python's fractions."""

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from dealtide.functions import exact
from dealtide.operators import utilization, wbs
from dealtide.sources.schemas import OPPORTUNITY


def half_away(value: Fraction, places: int) -> float:
    size = abs(value) * 10**places
    units = (2 * size.numerator + size.denominator) // (2 * size.denominator)
    return (-units if value < 0 else units) / 10**places


KINDS = [
    "decimal(14,4)", "decimal(18,14)", "decimal(18,10)", "decimal(28,20)", "decimal(38,18)", "decimal(38,0)",
    "decimal(38,30)", "decimal(38,38)", "decimal(9,0)", "decimal(5,5)", "decimal(19,19)", "bigint", "int", "tinyint",
]


def numbers(kind: str) -> tuple[int, list[tuple[int, Decimal]]]:
    """Scale, and (group, value) rows with ties, both signs and many digits."""
    digits, scale = map(int, kind[8:-1].split(",")) if kind.startswith("dec") else (2, 0)
    most = min(10 ** (digits - scale) - 1, 5000) if digits > scale else 0
    random.seed(kind)
    rows = []
    for group in range(30):
        for _ in range(random.choice([1, 2, 3, 7, 8])):
            shown = min(random.choice([1, 2, 3, scale]), scale)
            part = Decimal(random.randint(0, 10**shown - 1)).scaleb(-shown)
            rows.append((group, random.randint(-most, most) + part))
        if scale >= 2 and most >= 10:
            rows += [(group, Decimal("0.05")), (group, Decimal("-3.25"))][: group % 3]
    return scale, rows


@pytest.mark.parametrize("kind", KINDS)
def test_means_are_exact(spark, kind):
    with localcontext() as context:
        context.prec = 90
        scale, rows = numbers(kind)
        cell = [(g, Fraction(v.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP))) for g, v in rows]
    df = spark.createDataFrame([(g, f"{v:f}") for g, v in rows], "g int, v string")
    df = df.selectExpr("g", f"cast(v AS {kind}) AS v").repartition(3)
    of = exact.number(df, "v")
    assert of.exact
    got = df.groupBy("g").agg(*[of.mean(p).alias(f"m{p}") for p in (0, 1, 3)]).collect()
    for r in got:
        values = [v for g, v in cell if g == r.g]
        mean = sum(values) / len(values)
        assert [r.m0, r.m1, r.m3] == [half_away(mean, p) for p in (0, 1, 3)], (r.g, values)


def test_ratios_of_means(spark):
    """Equal and unequal counts, wide and narrow numbers, both signs, no rows."""
    rows = [
        (0, "1.5", "2.5"), (0, None, "3.25"), (0, "2.25", None), (0, "4", "1"),
        (1, "0.05", "1"), (1, "0.05", "1"),  # 5.0 of 100: a tie at one decimal below
        (2, "-7.125", "16"), (3, None, "1"), (4, "3", "0"), (5, "151.5", "1000"),
    ]
    for a, b in (("decimal(28,20)", "decimal(14,4)"), ("decimal(14,4)", "decimal(14,4)"), ("decimal(38,18)", "int")):
        df = spark.createDataFrame(rows, "g int, a string, b string").selectExpr(
            "g", f"cast(cast(a AS decimal(38,18)) AS {a}) AS a", f"cast(cast(b AS decimal(38,18)) AS {b}) AS b"
        )
        x, y = exact.number(df, "a"), exact.number(df, "b")
        sql = exact.ratio_of_means_sql(x, x.sums(), "count(a)", y, y.sums(), "count(b)", 100, 1)
        for r in df.groupBy("g").agg(F.expr(sql).alias("r"), F.collect_list("a").alias("x"), F.collect_list("b").alias("y")).collect():
            want = None
            if r.x and any(r.y):
                top, bottom = (sum(map(Fraction, v)) / len(v) for v in (r.x, r.y))
                want = half_away(100 * top / bottom, 1)
            assert r.r == want, (a, b, r)


def test_ratio_of_a_row(spark):
    for kind in ("decimal(28,20)", "decimal(38,18)", "decimal(14,4)", "decimal(18,14)"):
        df = spark.sql(
            f"SELECT cast(a AS {kind}) AS a, cast(b AS {kind}) AS b FROM VALUES"
            " (160.5BD, 168BD), (1, 0), (NULL, 1), (-1, 8), (0.0005, 1) AS t(a, b)"
        )
        got = [r[0] for r in df.select(exact.ratio_of_row(df, "a", "b", 100, 1)).collect()]
        assert got == [Decimal("95.5"), None, None, Decimal("-12.5"), Decimal("0.1")], kind


#: type of the number, its value, rows: all of them overflowed once.
LARGE = [
    ("decimal(18,14)", "1000.5", 200),
    ("decimal(18,10)", "1000.5", 2_000_000),
    ("decimal(28,20)", "1000.5", 1_000_000),
    ("decimal(38,18)", "1000.5", 100_000),
    ("decimal(38,30)", "1000.5", 1000),
]


@pytest.mark.parametrize("kind,value,rows", LARGE)
def test_hours_of_high_scale(spark, kind, value, rows):
    opps = spark.createDataFrame([("d",)], "id string").selectExpr(
        "id", "'Data' AS practice", "timestamp_ntz '2022-01-01' AS created_date", "date '2022-03-01' AS close_date",
        "true AS is_won", "true AS is_closed",
    )
    plan = spark.range(rows).selectExpr(
        "'d' AS opportunity_id", "timestamp_ntz '2022-02-01' AS created_date", "'Data Engineer' AS role",
        f"cast({value} AS {kind}) AS hours",
    )
    assert set(OPPORTUNITY.names) > set(opps.columns)
    [by_practice] = wbs.wbs_hours_by_practice(opps, plan).collect()
    assert (by_practice.avg_hours_per_opp, by_practice.num_opps) == (1000.5, 1)
    [by_role] = wbs.wbs_hours_by_role(opps, plan).collect()
    assert by_role.avg_hours_per_opp == 1000.5


@pytest.mark.parametrize(
    "kind,rows", [("decimal(18,14)", 200), ("decimal(28,20)", 1_000_000), ("decimal(38,18)", 100_000)]
)
def test_utilization_of_high_scale(spark, kind, rows):
    calculations = spark.range(1).selectExpr(
        "'c' AS id", "'p' AS time_period_id", "'ACS_Historical_Monthly_2023_1' AS name",
        "'Month' AS time_period_type", "date '2023-01-28' AS sched_end", "date '2023-01-28' AS hist_end",
        "false AS is_deleted",
    )
    details = spark.range(rows).selectExpr(
        "'c' AS calc_id", "'r' AS resource_id", "'Engineer' AS role", "'Data' AS practice",
        f"cast(80 AS {kind}) AS target", f"cast(500.25 AS {kind}) AS adj_target", f"cast(99.5 AS {kind}) AS price",
        f"cast(126.84 AS {kind}) AS billable_hours", f"cast(168 AS {kind}) AS calendar_hours",
        "timestamp_ntz '2023-05-05' AS last_modified", "'Month' AS time_period_type", "false AS is_deleted",
    )
    found = utilization.utilization_rows(calculations, details, year=2023)
    [r] = utilization.utilization_by_practice(found).collect()
    assert tuple(r) == ("Data", 15.1, 500.3, 75.5)
    [r] = utilization.utilization_by_role(found).collect()
    assert r.average_resource_price_usd == 100


def test_means_do_not_depend_on_the_order_of_rows(spark):
    random.seed(5)
    values = [f"{random.choice('-+')}{random.randint(0, 10**6)}.{random.randint(0, 10**18 - 1):018}" for _ in range(3000)]
    seen = set()
    for parts in (1, 7, 16):
        random.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("cast(v AS decimal(38,18)) AS v")
        seen.add(df.repartition(parts).agg(exact.number(df, "v").mean(3)).first()[0])
    assert seen == {half_away(sum(map(Fraction, values)) / len(values), 3)}
