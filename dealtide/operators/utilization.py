"""Monthly utilization of consultants and its roll-ups by practice, quarter and role."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealtide.functions.dates import in_year, quarter_label_of_month
from dealtide.functions.exact import Number, number, ratio_of_means_sql, ratio_of_row
from dealtide.functions.labels import CONSULTANT_ROLES, STAFF_PRACTICES, Rules, label_by_rules
from dealtide.operators.staffing import consultant_names

# Fixed value: calculations of past months; an underscore stands for any one character.
HISTORICAL_MONTHLY = "ACS_Historical_Monthly%"
_WIDE = "decimal(38,0)"


def _rows(calculation: DataFrame, detail: DataFrame, year: int) -> DataFrame:
    """Details of the historical months, with the resource, unlabelled."""
    months = calculation.filter(
        ~F.col("is_deleted")
        & F.col("time_period_id").isNotNull()
        & F.col("sched_end").isNotNull()
        & F.col("hist_end").isNotNull()
        & F.col("time_period_type").ilike("month")
        & F.col("name").ilike(HISTORICAL_MONTHLY)
    ).select(
        F.col("id").alias("calc_id"),
        F.split_part("name", F.lit("_"), F.lit(5)).alias("month"),
    )
    worked = detail.filter(
        ~F.col("is_deleted")
        & in_year(F.col("last_modified"), year)
        & F.col("time_period_type").ilike("month")
        & (F.col("target") > 0)
        & (F.col("adj_target") > 0)
    )
    effective = ratio_of_row(detail, "billable_hours", "calendar_hours", 100, 1)
    return worked.join(months, "calc_id").select(
        "resource_id",
        F.col("role").alias("resource_role"),
        F.col("price").alias("resource_price"),
        "practice",
        "month",
        F.col("target").alias("util_target"),
        F.col("adj_target").alias("adjusted_util_target"),
        effective.alias("effective_utilization"),
    )


def utilization_rows(calculation: DataFrame, detail: DataFrame, *, year: int) -> DataFrame:
    """The rows of the master view without names, labels and order, for the roll-ups, which label what they have folded."""
    return _rows(calculation, detail, year)


def master_utilization(
    calculation: DataFrame,
    detail: DataFrame,
    actuals: DataFrame,
    *,
    year: int,
    rules: Rules = STAFF_PRACTICES,
) -> DataFrame:
    """One row per consultant and month of the details last modified in ``year``."""
    rows = (
        _rows(calculation, detail, year)
        .join(consultant_names(actuals), "resource_id", "left")
        .select(
            "consultant_name",
            "resource_role",
            "resource_price",
            "practice",
            "month",
            "util_target",
            "adjusted_util_target",
            "effective_utilization",
        )
    )
    # The columns after the month fix the order of equal months; they also let the sort
    # spread a consultant with very many rows over several partitions.
    order = (
        "practice",
        "consultant_name",
        "month",
        "resource_role",
        "effective_utilization",
        "resource_price",
        "adjusted_util_target",
        "util_target",
    )
    return label_by_rules(rows, "practice", rules, "practice").orderBy(
        *[F.asc_nulls_last(name) for name in order]
    )


_REACHED, _TARGET, _PRICE = "effective_utilization", "adjusted_util_target", "resource_price"


def _folded(rows: DataFrame, keys: Sequence[str], measures: Sequence[str] = (_REACHED, _TARGET)) -> DataFrame:
    """Per distinct value of the keys: the limbs of the measures' totals (see `number`), and their counts.

    Label rules have up to 17 patterns; they run on this, not on the rows.
    """
    sums = []
    for name in measures:
        of_row = number(rows, name)
        sums += [F.expr(total).alias(f"{name}_{i}") for i, total in enumerate(of_row.sums())]
        sums.append(F.count(name).alias(f"{name}_n"))
    return rows.groupBy(*keys).agg(*sums)


def _totals(rows: DataFrame, name: str) -> tuple[Number, list[str], str]:
    """A measure with the SQL of its totals and its count over folded rows."""
    of_row = number(rows, name)
    return of_row, [f"sum({name}_{i})" for i in range(len(of_row.limbs))], f"sum({name}_n)"


def _averages(rows: DataFrame) -> list[Column]:
    """The means of folded rows; rows: before they were folded."""
    reached, target = _totals(rows, _REACHED), _totals(rows, _TARGET)
    percent = ratio_of_means_sql(*reached, *target, 100, 1)
    return [
        F.expr(percent).alias("percent_of_util_achieved"),
        target[0].rounded(*target[1:], 1).alias("average_utilization_target"),
        reached[0].rounded(*reached[1:], 1).alias("average_utilization"),
    ]


def _by_practice(rows: DataFrame, rules: Rules | None, *others: str) -> DataFrame:
    """Folded to practice and others, with practices labelled; a label is NULL only if the practice is."""
    folded = _folded(rows.filter(F.col("practice").isNotNull()), ["practice", *others])
    return folded if rules is None else label_by_rules(folded, "practice", rules, "practice")


def utilization_by_practice(rows: DataFrame, *, rules: Rules | None = None) -> DataFrame:
    """Mean utilization against target by practice; practices without hours are left out.

    rows, here and below: `utilization_rows`, with the rules that label their practices, or the master view, which has the labels and costs
    the names.
    """
    return (
        _by_practice(rows, rules)
        .groupBy("practice")
        .agg(*_averages(rows))
        .filter(F.col("average_utilization").isNotNull())
        .orderBy(F.desc_nulls_last("percent_of_util_achieved"), "practice")
    )


def utilization_by_practice_quarter(rows: DataFrame, *, rules: Rules | None = None) -> DataFrame:
    return (
        _by_practice(rows, rules, "month")
        .groupBy("practice", quarter_label_of_month(F.col("month")).alias("quarter"))
        .agg(*_averages(rows))
        .orderBy("practice", F.asc_nulls_last("quarter"))
    )


def utilization_by_role(rows: DataFrame, *, rules: Rules = CONSULTANT_ROLES) -> DataFrame:
    """Mean price and utilization by role; roles without a rule are left out."""
    folded = _folded(rows, ["resource_role"], (_REACHED, _TARGET, _PRICE))
    price = _totals(rows, _PRICE)
    return (
        label_by_rules(folded, "resource_role", rules, name="resource_roles")
        .filter(F.col("resource_roles").isNotNull())
        .groupBy("resource_roles")
        .agg(
            price[0].rounded(*price[1:], 0).alias("average_resource_price_usd"),
            *_averages(rows),
        )
        .orderBy(F.desc_nulls_last("percent_of_util_achieved"), "resource_roles")
    )


def utilization_fact_join(
    calculation: DataFrame, detail: DataFrame, summary: DataFrame, actuals: DataFrame
) -> DataFrame:
    """Size of the many-to-many join of all utilization tables, per calculation.

    Details and summaries are both many per calculation, and a resource has several actuals,
    so the joined rows multiply. They are counted from the counts of each side, never formed.
    Calculations without a joined row are left out.
    """
    copies = actuals.groupBy("resource_id").agg(F.count("*").alias("copies"))
    details = (
        detail.groupBy("calc_id", "resource_id")
        .agg(F.count("*").alias("details"))
        .join(copies, "resource_id", "left")
        .groupBy("calc_id")
        .agg(
            F.sum("details").alias("num_detail"),
            # A fan-out passes the range of a long.
            F.sum(F.col("details").cast(_WIDE) * F.col("copies")).cast(_WIDE).alias("named"),
        )
    )
    summaries = summary.groupBy("calc_id").agg(F.count("*").alias("num_summary"))
    return (
        calculation.select(F.col("id").alias("calc_id"))
        .join(details.filter(F.col("named") > 0), "calc_id")
        .join(summaries, "calc_id")
        .select(
            F.col("calc_id").alias("util_calc_id"),
            "num_detail",
            "num_summary",
            (F.col("named") * F.col("num_summary")).cast(_WIDE).alias("num_fanout"),
        )
    )


def utilization_fact_rows(
    calculation: DataFrame,
    detail: DataFrame,
    summary: DataFrame,
    actuals: DataFrame,
    *,
    limit: int | None = None,
) -> DataFrame:
    """The rows of that join: util_calc_id, resource_id, resource_name, then every other column of calculation, detail and
    summary as calc_*, detail_* and summary_*.

    ``limit``: the first rows in order of calculation, then detail and name, then summary (each in order of its columns, nulls
    first). The join isn't formed for them: from the counts of each side it is known which calculations, which of
    their details and which of their summaries the first rows are made of, and only those are read out and joined.
    """
    calcs = _prefixed(calculation, "calc", "id", "util_calc_id")
    details = _prefixed(detail, "detail", "calc_id", "util_calc_id").withColumnRenamed(
        "detail_resource_id", "resource_id"
    )
    summaries = _prefixed(summary, "summary", "calc_id", "util_calc_id")
    names = actuals.select("resource_id", F.col("name").alias("resource_name"))
    shown = list(
        dict.fromkeys(
            ["util_calc_id", "resource_id", "resource_name", *calcs.columns, *details.columns, *summaries.columns]
        )
    )
    key = "util_calc_id"
    if limit is None:
        rows = details.join(names, "resource_id").join(calcs, key).join(summaries, key)
        return rows.select(*shown)
    sizes = utilization_fact_join(calculation, detail, summary, actuals)
    # At most `limit` calculations have a row among the first, as each has one at least.
    earlier = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    first = (
        sizes.orderBy(key)
        .limit(limit)
        .withColumn("_before", F.coalesce(F.sum("num_fanout").over(earlier), F.lit(0)))
        .filter(F.col("_before") < limit)
        .select(
            key,
            F.col("num_summary").alias("_summaries"),
            F.least("num_fanout", limit - F.col("_before")).cast("bigint").alias("_rows"),
        )
    )
    # Row number of a calculation: place among named details, times summaries, plus place among summaries.
    of_calc = first.withColumn("_needed", F.expr("(_rows + _summaries - 1) div _summaries"))
    copies = names.groupBy("resource_id").agg(F.count("*").alias("_copies"))
    among = Window.partitionBy(key)
    in_order = among.orderBy(*details.columns)
    ranked = (
        details.join(names, "resource_id", "left_semi")
        .join(of_calc.select(key), key, "left_semi")
        .withColumn("_place", F.row_number().over(in_order))
        .filter(F.col("_place") <= limit)
        .join(of_calc, key)
        .filter(F.col("_place") <= F.col("_needed"))
        .join(copies, "resource_id")
    )
    passed = among.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    chosen = ranked.withColumn("_from", F.coalesce(F.sum("_copies").over(passed), F.lit(0))).filter(
        F.col("_from") < F.col("_needed")
    )
    wanted = chosen.select("resource_id").distinct()
    copy = F.row_number().over(Window.partitionBy("resource_id").orderBy("resource_name")) - 1
    named = (
        names.join(wanted, "resource_id", "left_semi").withColumn("_copy", copy).filter(F.col("_copy") < limit)
    )
    left = chosen.join(named, "resource_id").withColumn("_named", F.col("_from") + F.col("_copy"))
    place = F.row_number().over(among.orderBy(*summaries.columns)) - 1
    right = (
        summaries.join(of_calc.select(key), key, "left_semi")
        .withColumn("_summary", place)
        .filter(F.col("_summary") < limit)
    )
    rows = left.filter(F.col("_named") < F.col("_needed")).join(right, key)
    return (
        rows.filter(F.col("_named") * F.col("_summaries") + F.col("_summary") < F.col("_rows"))
        .join(calcs, key)
        .select(*shown)
    )


def _prefixed(df: DataFrame, prefix: str, key: str, name: str) -> DataFrame:
    """Columns with a prefix, but the key, which gets the name."""
    return df.select(
        *[F.col(c).alias(name if c == key else f"{prefix}_{c}") for c in df.columns]
    )
