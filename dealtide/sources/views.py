"""The dashboard views by name: as session views, or written as tables that outlast the session."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame

from dealtide.functions.labels import Rules, staff_practices
from dealtide.operators import dashboard, staffing, utilization
from dealtide.sources.tables import Tables


def dashboard_views(
    tables: Tables,
    *,
    as_of: dt.date | None = None,
    years: Iterable[int] = (2021, 2022, 2023),
    held_since: int = 2021,
    org: str | None = None,
    staff_rules: Rules | None = None,
) -> dict[str, DataFrame]:
    """Every dashboard view by name. Nothing is computed until a view is read.

    ``org``, the house's own brand, labels its own practice in the utilization views; ``staff_rules`` replaces
    the rules altogether.
    """
    t = tables
    rules = staff_practices(org) if staff_rules is None else staff_rules
    hours = dashboard.wbs_hours_by_practice_quarter(t.opportunity, t.wbs, as_of=as_of)
    wins = dashboard.win_rate_by_practice_quarter(t.opportunity, as_of=as_of)
    views = {
        "avg_num_days_to_opp_close_by_stage_and_quarter": dashboard.stage_days_by_practice_quarter(
            t.opportunity, t.opportunity_field_history, as_of=as_of
        ),
        "avg_num_days_to_opp_close_by_stage_and_year": dashboard.stage_days_by_practice_year(
            t.opportunity, t.opportunity_field_history, as_of=as_of
        ),
        "opp_win_percentage_by_practice": wins,
        "opps_avg_median_days_to_close": dashboard.days_to_close_by_practice_year(
            t.opportunity, as_of=as_of
        ),
        "opps_w_wbs": hours,
        "opps_wbs_hours_and_win_rate": dashboard.wbs_hours_and_win_rate(hours, wins),
        "resource_held_for_lost_opps": staffing.held_for_lost_by_practice_quarter(
            t.resource_request,
            t.opportunity,
            t.resource_request_history,
            t.resource_actuals,
            as_of=as_of,
            min_year=held_since,
        ),
    }
    for year in years:
        master = utilization.master_utilization(
            t.utilization_calculation,
            t.utilization_detail,
            t.resource_actuals,
            year=year,
            rules=rules,
        )
        rows = utilization.utilization_rows(
            t.utilization_calculation, t.utilization_detail, year=year
        )
        views[f"master_utilization_{year}"] = master
        views[f"average_utilization_per_practice_{year}"] = utilization.utilization_by_practice(
            rows, rules=rules
        )
        views[f"average_utilization_per_practice_per_quarter_{year}"] = (
            utilization.utilization_by_practice_quarter(rows, rules=rules)
        )
        views[f"average_utilization_per_resource_{year}"] = utilization.utilization_by_role(rows)
    return views


def publish(views: dict[str, DataFrame]) -> None:
    """Create or replace a session view for each; a later read sees the tables of that time."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_views(
    views: dict[str, DataFrame], namespace: str, *, file_format: str = "parquet"
) -> None:
    """Write each view as a table ``<namespace>.<name>`` of the catalog, in place of what is there.

    The tables outlast the session, so BI tools read them by name. Their columns are in the order of the view;
    they hold the rows of the time of writing.
    """
    for name, df in views.items():
        df.write.mode("overwrite").format(file_format).saveAsTable(f"{namespace}.{name}")
