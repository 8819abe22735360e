"""The dashboard views as lasting views of a catalog: definitions in SQL, computed when they are read.

Three layers, each a view on the one below: a view per base table under neutral names and types (``base_*``), the report
views, and views on report views. All outlast the session, follow their tables, and name their columns by position.
The definitions fold before they join, as the operators do, whose SQL fragments they share.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from dealtide.functions.exact import (
    number,
    percent_sql,
    ratio_of_means_sql,
    ratio_of_row_sql,
    ratio_sql,
)
from dealtide.functions.labels import (
    CONSULTANT_ROLES,
    DEAL_PRACTICES,
    NO_PRACTICE,
    Rules,
    case_sql,
    staff_practices,
)
from dealtide.operators.funnel import stage_means_sql, stage_totals_sql
from dealtide.operators.utilization import HISTORICAL_MONTHLY
from dealtide.plans.changes import (
    STAGE_FIELD,
    STAGES,
    pick_of_day_sql,
    stage_code_sql,
    stage_measures_sql,
)
from dealtide.plans.holds import HELD_FIELD, STAFFER_FIELD
from dealtide.plans.trim import inside_sql, moments_sql
from dealtide.sources.schemas import CRM_TABLES, TABLES, conform_sql, crm_columns, quoted

_WON = "is_closed AND is_won"
_LOST = "is_closed AND NOT is_won"
_DAYS = "datediff(close_date, created_date)"


@dataclass(frozen=True)
class Definition:
    """A view: the names of its columns, by position, and its statement."""

    columns: Sequence[str]
    statement: str


def _path(name: str) -> str:
    return ".".join(quoted(part) for part in name.split("."))


def _named(names: Sequence[str], expressions: Sequence[str]) -> str:
    """A select list: a lasting view wants every expression to have a name."""
    return ", ".join(f"{e} AS {quoted(n)}" for n, e in zip(names, expressions, strict=True))


def _with(body: str, **parts: str) -> str:
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    return f"WITH {listed}\n{body}"


class _Texts:
    """Statements over the base views of a namespace."""

    def __init__(self, namespace: str, as_of: dt.date | None, deal_rules: Rules):
        self.namespace = namespace
        self.today = "current_date()" if as_of is None else f"DATE '{as_of}'"
        self.deal_rules = deal_rules

    def base(self, name: str) -> str:
        return _path(f"{self.namespace}.base_{name}")

    def view(self, name: str) -> str:
        return _path(f"{self.namespace}.{name}")

    def years(self, years: int) -> str:
        return (
            f"close_date >= trunc(add_months({self.today}, {-12 * years}), 'year') AND close_date <= {self.today}"
        )

    def quarters(self, quarters: int) -> str:
        first = f"cast(add_months(trunc({self.today}, 'quarter'), {-3 * quarters}) AS date)"
        return f"close_date >= {first} AND close_date <= {self.today}"

    def closed(self, test: str, *columns: str) -> str:
        """Deals that pass, with practice, closing year and quarter."""
        listed = ", ".join(columns)
        return (
            f"SELECT practice, year(close_date) AS y, quarter(close_date) AS q, {listed}"
            f" FROM {self.base('opportunity')} WHERE {test}"
        )

    def labelled(self, source: str) -> str:
        """A folded relation with labels in place of practices."""
        label = case_sql("lower(practice)", self.deal_rules, f"'{NO_PRACTICE}'")
        return f"SELECT * EXCEPT (practice), {label} AS practice FROM {source}"

    def stage_days(self, window: str, keys: Sequence[str], min_days: int, k: float) -> Definition:
        grouped = ", ".join(keys)
        names = {"practice": "practice", "y": "year_opp_closed", "q": "quarter_opp_closed"}
        means = [f"{name}_avg_days_till_close" for name, _ in STAGES]
        in_order = ", ".join(f"{key} NULLS LAST" for key in keys)
        body = (
            f"SELECT {grouped}, sum(num_opps) AS num_opps, {', '.join(stage_means_sql())} FROM kept"
            f" GROUP BY {grouped} ORDER BY {in_order}"
        )
        return Definition(
            [*[names[key] for key in keys], "num_opps", *means],
            _with(
                body,
                listed=self.closed(
                    f"{_WON} AND {window} AND {_DAYS} > {min_days}", "id", "close_date", f"{_DAYS} AS days"
                ),
                deal="SELECT id, deal.* FROM (SELECT id, min(struct(close_date, days, practice, y, q)) AS deal"
                " FROM listed GROUP BY id)",
                daily="SELECT opportunity_id, to_date(created_date) AS change_day,"
                f" {pick_of_day_sql('max', stage_code_sql('stage'))} AS stages"
                " FROM (SELECT opportunity_id, created_date, lower(new_value) AS stage"
                f" FROM {self.base('opportunity_field_history')} WHERE lower(field) = '{STAGE_FIELD}')"
                " GROUP BY opportunity_id, to_date(created_date)",
                changed=f"SELECT opportunity_id, {', '.join(stage_measures_sql())} FROM daily GROUP BY opportunity_id",
                folded=f"SELECT {grouped}, days, {', '.join(stage_totals_sql())}"
                f" FROM deal JOIN changed ON id = opportunity_id GROUP BY {grouped}, days",
                histogram=f"SELECT *, {', '.join(moments_sql('days', 'changes'))} FROM ({self.labelled('folded')})",
                kept=f"SELECT * FROM histogram WHERE {inside_sql('days', k)}",
            ),
        )

    def win_rate(self, years: int) -> Definition:
        names = (
            "practice", "year_opp_closed", "quarter_opp_closed", "won_opps", "all_closed_opps", "lost_opps",
            "opp_win_percent",
        )
        shown = (
            "practice", "if(won > 0, y, NULL)", "if(won > 0, q, NULL)", "if(won > 0, won, NULL)", "closed",
            "if(won > 0, closed - won, NULL)", percent_sql("won", "closed"),
        )
        return Definition(
            names,
            _with(
                f"SELECT {_named(names, shown)}"
                " FROM counted WHERE closed > 0 ORDER BY 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST",
                deal=self.closed(f"is_closed AND {self.years(years)}", "is_closed", "is_won", "stage_name"),
                folded=f"SELECT practice, y, q, count_if({_WON}) AS won,"
                " count_if(is_closed AND NOT lower(stage_name) LIKE '%duplicate%') AS closed"
                " FROM deal GROUP BY practice, y, q",
                counted="SELECT practice, y, q, sum(won) AS won, sum(closed) AS closed"
                f" FROM ({self.labelled('folded')}) GROUP BY practice, y, q",
            ),
        )

    def days_to_close(self, years: int, min_days: int, k: float) -> Definition:
        names = ("practice", "year_opp_closed", "num_opps_won", "median_days_to_close", "avg_days_to_close")
        shown = ("practice", "y", "sum(n)", "percentile(days, 0.5, n)", ratio_sql("sum(days * n)", "sum(n)", 1))
        return Definition(
            names,
            _with(
                f"SELECT {_named(names, shown)} FROM histogram WHERE {inside_sql('days', k)}"
                " GROUP BY practice, y ORDER BY 1 NULLS LAST, 2 NULLS LAST",
                deal=self.closed(f"{_WON} AND {self.years(years)} AND {_DAYS} > {min_days}", f"{_DAYS} AS days"),
                folded="SELECT practice, y, days, count(*) AS n FROM deal GROUP BY practice, y, days",
                histogram=f"SELECT *, {', '.join(moments_sql('days', 'n'))} FROM ({self.labelled('folded')})",
            ),
        )

    def hours(self, spark: SparkSession, years: int, drop: Sequence[str]) -> Definition:
        hours = number(spark.table(self.base("wbs")), "hours")
        limbs = [f"h{i}" for i in range(len(hours.limbs))]
        sums = ", ".join(f"sum({limb}) AS {name}" for limb, name in zip(hours.limbs, limbs, strict=True))
        picks = ", ".join(f"max_by({name}, created_date) AS {name}" for name in (*limbs, "entries"))
        dropped = ", ".join("'" + label.lower().replace("'", "\\'") + "'" for label in drop)
        kept = f"WHERE lower(practice) NOT IN ({dropped})" if drop else ""
        mean = hours.mean_sql([f"sum({name})" for name in limbs], "sum(entries)", 1)
        names = ("year_opp_closed", "quarter_opp_closed", "practice", "avg_hours_per_opp", "num_opps_w_wbs")
        shown = ("y", "q", "practice", mean, "count(DISTINCT opportunity_id)")
        return Definition(
            names,
            _with(
                f"SELECT {_named(names, shown)}"
                f" FROM (SELECT * FROM ({self.labelled('deal')}) {kept}) JOIN newest USING (opportunity_id)"
                " GROUP BY y, q, practice ORDER BY 3 NULLS LAST, 1 NULLS LAST, 2 NULLS LAST",
                deal=self.closed(f"{_WON} AND {self.years(years)}", "id AS opportunity_id"),
                batch=f"SELECT opportunity_id, created_date, {sums}, count({hours.limbs[0]}) AS entries"
                f" FROM {self.base('wbs')} WHERE hours <> 0 GROUP BY opportunity_id, created_date",
                newest=f"SELECT opportunity_id, {picks} FROM batch GROUP BY opportunity_id",
            ),
        )

    def hours_and_win_rate(self) -> Definition:
        keys = ("practice", "year_opp_closed", "quarter_opp_closed")
        others = (
            "avg_hours_per_opp", "num_opps_w_wbs", "won_opps", "all_closed_opps", "lost_opps", "opp_win_percent",
        )
        in_order = ", ".join(f"{key} NULLS LAST" for key in keys)
        return Definition(
            (*keys, *others),
            f"SELECT {', '.join((*keys, *others))} FROM {self.view('opps_w_wbs')}"
            f" FULL JOIN {self.view('opp_win_percentage_by_practice')} USING ({', '.join(keys)})"
            " WHERE year_opp_closed IS NOT NULL AND quarter_opp_closed IS NOT NULL"
            f" ORDER BY {in_order}",
        )

    def held(self, since: int, min_days: int) -> Definition:
        released = f"CASE WHEN lower(field) = '{HELD_FIELD}' AND try_cast(old_value AS boolean) THEN created_date END"
        assigned = f"CASE WHEN lower(field) = '{STAFFER_FIELD}' AND NOT contains(new_value, '0') THEN created_date END"
        names = (
            "practice", "year_opp_closed", "qtr_opp_closed", "num_resources_held_and_opp_lost",
            "num_opps_lost_w_resources_held",
        )
        shown = (
            "practice", "year(close_date)", "concat('Q', quarter(close_date))", "count(DISTINCT id)",
            "count(DISTINCT opportunity_id)",
        )
        return Definition(
            names,
            _with(
                f"SELECT {_named(names, shown)} FROM held WHERE days >= {min_days}"
                " GROUP BY 1, 2, 3 ORDER BY 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST",
                deal=f"SELECT id AS deal_id, close_date FROM {self.base('opportunity')}"
                f" WHERE {_LOST} AND close_date >= DATE '{since}-01-01' AND close_date <= {self.today}",
                request=f"SELECT id, opportunity_id, practice, created_date, close_date"
                f" FROM {self.base('resource_request')} AS r JOIN deal ON opportunity_id = deal_id"
                f" LEFT SEMI JOIN {self.base('resource_actuals')} AS a ON a.resource_id = r.resource_id",
                mark=f"SELECT parent_id, max({assigned}) AS last_change, min({released}) AS first_hold,"
                f" max({released}) AS last_hold, max(created_date) AS final_change"
                f" FROM {self.base('resource_request_history')} GROUP BY parent_id",
                held="SELECT *, if(last_change IS NOT NULL,"
                " coalesce(datediff(last_hold, last_change), datediff(final_change, last_change)),"
                " coalesce(datediff(first_hold, created_date), datediff(final_change, created_date))) AS days"
                " FROM request JOIN mark ON parent_id = id",
            ),
        )

    def master(self, spark: SparkSession, year: int, rules: Rules) -> Definition:
        detail = spark.table(self.base("utilization_detail"))
        pair = ("billable_hours", "calendar_hours")
        reached = ratio_of_row_sql(
            *[number(detail, name) for name in pair], 100, 1, [detail.schema[name].dataType for name in pair]
        )
        label = case_sql("lower(practice)", rules, "practice")
        return Definition(
            (
                "consultant_name", "resource_role", "resource_price", "practice", "month", "util_target",
                "adjusted_util_target", "effective_utilization",
            ),
            _with(
                f"SELECT consultant_name, role, price, {label} AS practice, month, target, adj_target, {reached} AS reached"
                " FROM worked JOIN months USING (calc_id) LEFT JOIN people USING (resource_id)"
                " ORDER BY practice NULLS LAST, consultant_name NULLS LAST, month NULLS LAST",
                months="SELECT id AS calc_id, split_part(name, '_', 5) AS month"
                f" FROM {self.base('utilization_calculation')} WHERE NOT is_deleted AND time_period_id IS NOT NULL"
                " AND sched_end IS NOT NULL AND hist_end IS NOT NULL AND time_period_type ILIKE 'month'"
                f" AND name ILIKE '{HISTORICAL_MONTHLY}'",
                worked=f"SELECT * FROM {self.base('utilization_detail')} WHERE NOT is_deleted"
                f" AND last_modified >= DATE '{year}-01-01' AND last_modified < DATE '{year + 1}-01-01'"
                " AND time_period_type ILIKE 'month' AND target > 0 AND adj_target > 0",
                people="SELECT resource_id, split_part(min(name), ' - ', 1) AS consultant_name"
                f" FROM {self.base('resource_actuals')} GROUP BY resource_id",
            ),
        )

    def averages(self, spark: SparkSession, year: int, by: str) -> Definition:
        """A roll-up of the master view; by: practice, quarter or role."""
        master = spark.table(self.view(f"master_utilization_{year}"))
        names = ("effective_utilization", "adjusted_util_target", "resource_price")
        reached, target, price = (number(master, name) for name in names)

        def of(measure, name: str) -> tuple:
            return measure, measure.sums(), f"count({name})"

        percent = ratio_of_means_sql(*of(reached, names[0]), *of(target, names[1]), 100, 1)
        means = (
            f"{percent} AS percent_of_util_achieved,"
            f" {target.mean_sql(target.sums(), f'count({names[1]})', 1)} AS average_utilization_target,"
            f" {reached.mean_sql(reached.sums(), f'count({names[0]})', 1)} AS average_utilization"
        )
        measures = ("percent_of_util_achieved", "average_utilization_target", "average_utilization")
        source = self.view(f"master_utilization_{year}")
        if by == "practice":
            return Definition(
                ("practice", *measures),
                f"SELECT practice, {means} FROM {source} WHERE practice IS NOT NULL GROUP BY practice"
                f" HAVING count({names[0]}) > 0 ORDER BY percent_of_util_achieved DESC NULLS LAST, practice",
            )
        if by == "quarter":
            month = "try_cast(month AS int)"
            quarter = f"if({month} BETWEEN 1 AND 12, concat('Q', cast(ceil({month} / 3) AS string)), NULL)"
            return Definition(
                ("practice", "quarter", *measures),
                f"SELECT practice, quarter, {means} FROM (SELECT *, {quarter} AS quarter FROM {source})"
                " WHERE practice IS NOT NULL GROUP BY practice, quarter ORDER BY practice, quarter NULLS LAST",
            )
        role = case_sql("lower(resource_role)", CONSULTANT_ROLES)
        cost = price.mean_sql(price.sums(), f"count({names[2]})", 0)
        return Definition(
            ("resource_roles", "average_resource_price_usd", *measures),
            f"SELECT resource_roles, {cost} AS average_resource_price_usd, {means} FROM (SELECT *, {role} AS resource_roles FROM {source})"
            " WHERE resource_roles IS NOT NULL GROUP BY resource_roles"
            " ORDER BY percent_of_util_achieved DESC NULLS LAST, resource_roles",
        )


def create_views(
    spark: SparkSession,
    source: str,
    target: str,
    org: str,
    *,
    as_of: dt.date | None = None,
    years: Iterable[int] = (2021, 2022, 2023),
    held_since: int = 2021,
    deal_rules: Rules = DEAL_PRACTICES,
    staff_rules: Rules | None = None,
    tables: Mapping[str, str] = CRM_TABLES,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    min_days: int = 1,
    k: float = 3,
    min_held_days: int = 10,
    drop: Sequence[str] = ("Managed Services",),
) -> list[str]:
    """Create or replace the dashboard views in the namespace ``target`` over the base tables in ``source``; their names.

    Nothing is computed: a view holds its definition, and a read, in this session or a later one, sees the tables of that time.
    ``as_of``: a fixed report date, else the day of the read. ``org``, tables and columns as in `catalog_tables`. A view also keeps the types that the
    base tables had when it was made, so create the views anew if those change.
    """
    renamed = crm_columns(org) if columns is None else columns
    rules = staff_practices(org) if staff_rules is None else staff_rules
    texts = _Texts(target, as_of, deal_rules)
    made: list[str] = []

    def create(name: str, view: Definition) -> None:
        listed = ", ".join(quoted(c) for c in view.columns)
        spark.sql(f"CREATE OR REPLACE VIEW {_path(f'{target}.{name}')} ({listed}) AS {view.statement}")
        made.append(name)

    for name, schema in TABLES.items():
        path = _path(f"{source}.{tables[name]}")
        of_source: T.StructType = spark.table(path).schema
        shown = ", ".join(conform_sql(of_source, schema, renamed.get(name)))
        create(f"base_{name}", Definition(schema.names, f"SELECT {shown} FROM {path}"))
    by_quarter = texts.stage_days(texts.quarters(3), ("practice", "y", "q"), min_days, k)
    create("avg_num_days_to_opp_close_by_stage_and_quarter", by_quarter)
    by_year = texts.stage_days(texts.years(2), ("y", "practice"), min_days, k)
    create("avg_num_days_to_opp_close_by_stage_and_year", by_year)
    create("opp_win_percentage_by_practice", texts.win_rate(2))
    create("opps_avg_median_days_to_close", texts.days_to_close(2, min_days, k))
    create("opps_w_wbs", texts.hours(spark, 2, drop))
    create("opps_wbs_hours_and_win_rate", texts.hours_and_win_rate())
    create("resource_held_for_lost_opps", texts.held(held_since, min_held_days))
    for year in years:
        create(f"master_utilization_{year}", texts.master(spark, year, rules))
        for name, by in (
            ("practice", "practice"), ("practice_per_quarter", "quarter"), ("resource", "role"),
        ):
            create(f"average_utilization_per_{name}_{year}", texts.averages(spark, year, by))
    return made
