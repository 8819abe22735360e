"""Schemas of the base tables under neutral names, and the mapping from CRM column names.

Values that a CRM export carries as text (booleans, dates, numbers) are cast on load;
text that does not parse becomes NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Stands for any numeric type: numbers keep the type of their source.
_NUMBER = T.DecimalType(14, 4)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


OPPORTUNITY = _schema(
    id=T.StringType(),
    name=T.StringType(),
    practice=T.StringType(),
    practice_2=T.StringType(),
    created_date=T.TimestampNTZType(),
    close_date=T.DateType(),
    stage_name=T.StringType(),
    is_won=T.BooleanType(),
    is_closed=T.BooleanType(),
    created_by_id=T.StringType(),
    reason_code=T.StringType(),
    job_id=T.StringType(),
    fiscal_quarter=T.IntegerType(),
    fiscal_year=T.IntegerType(),
    territory=T.StringType(),
)
OPPORTUNITY_FIELD_HISTORY = _schema(
    opportunity_id=T.StringType(),
    created_date=T.TimestampNTZType(),
    field=T.StringType(),
    old_value=T.StringType(),
    new_value=T.StringType(),
)
WBS = _schema(
    opportunity_id=T.StringType(),
    created_date=T.TimestampNTZType(),
    role=T.StringType(),
    hours=_NUMBER,
)
RESOURCE_REQUEST = _schema(
    id=T.StringType(),
    opportunity_id=T.StringType(),
    resource_id=T.StringType(),
    practice=T.StringType(),
    role=T.StringType(),
    created_date=T.TimestampNTZType(),
)
RESOURCE_REQUEST_HISTORY = _schema(
    parent_id=T.StringType(),
    created_date=T.TimestampNTZType(),
    field=T.StringType(),
    old_value=T.StringType(),
    new_value=T.StringType(),
)
RESOURCE_ACTUALS = _schema(resource_id=T.StringType(), name=T.StringType())
UTILIZATION_CALCULATION = _schema(
    id=T.StringType(),
    time_period_id=T.StringType(),
    name=T.StringType(),
    time_period_type=T.StringType(),
    sched_end=T.DateType(),
    hist_end=T.DateType(),
    calc_hist_util=T.BooleanType(),
    calc_sched_util=T.BooleanType(),
    is_deleted=T.BooleanType(),
)
UTILIZATION_DETAIL = _schema(
    calc_id=T.StringType(),
    resource_id=T.StringType(),
    role=T.StringType(),
    practice=T.StringType(),
    target=_NUMBER,
    adj_target=_NUMBER,
    price=_NUMBER,
    billable_hours=_NUMBER,
    calendar_hours=_NUMBER,
    last_modified=T.TimestampNTZType(),
    time_period_type=T.StringType(),
    is_deleted=T.BooleanType(),
)
UTILIZATION_SUMMARY = _schema(calc_id=T.StringType(), created_date=T.TimestampNTZType())

TABLES: Mapping[str, T.StructType] = {
    "opportunity": OPPORTUNITY,
    "opportunity_field_history": OPPORTUNITY_FIELD_HISTORY,
    "wbs": WBS,
    "resource_request": RESOURCE_REQUEST,
    "resource_request_history": RESOURCE_REQUEST_HISTORY,
    "resource_actuals": RESOURCE_ACTUALS,
    "utilization_calculation": UTILIZATION_CALCULATION,
    "utilization_detail": UTILIZATION_DETAIL,
    "utilization_summary": UTILIZATION_SUMMARY,
}

# Table and column names of the CRM. Columns not listed keep their name.
CRM_TABLES: Mapping[str, str] = {
    "opportunity": "opportunity",
    "opportunity_field_history": "opportunity_field_history",
    "wbs": "wbs_actuals_c",
    "resource_request": "pse_resource_request_c",
    "resource_request_history": "pse_resource_request_history",
    "resource_actuals": "pse_resource_actuals_c",
    "utilization_calculation": "pse_utilization_calculation_c",
    "utilization_detail": "pse_utilization_detail_c",
    "utilization_summary": "pse_utilization_summary_c",
}


def crm_columns(org: str) -> dict[str, dict[str, str]]:
    """CRM column of each neutral column; ``org`` is the prefix of the house's own columns."""
    return {
        "opportunity": {
            "practice": f"{org}_practice_c",
            "practice_2": f"{org}_practice_1_c",
            "reason_code": "reason_code_c",
            "job_id": "job_id_c",
            "territory": "parent_territory_c",
        },
        "wbs": {"opportunity_id": "opportunity_c", "role": "role_c", "hours": "wbs_hours_c"},
        "resource_request": {
            "opportunity_id": "pse_opportunity_c",
            "resource_id": "pse_resource_c",
            "practice": "resource_practice_c",
            "role": "pse_resource_role_c",
        },
        "resource_actuals": {"resource_id": "pse_resource_c"},
        "utilization_calculation": {
            "time_period_id": "pse_time_period_c",
            "time_period_type": "pse_time_period_types_c",
            "sched_end": "pse_scheduled_utilization_end_date_c",
            "hist_end": "pse_historical_utilization_end_date_c",
            "calc_hist_util": "pse_calculate_historical_utilization_c",
            "calc_sched_util": "pse_calculate_scheduled_utilization_c",
        },
        "utilization_detail": {
            "calc_id": "pse_utilization_calculation_c",
            "resource_id": "pse_resource_c",
            "role": "resource_role_c",
            "practice": f"{org}_practice_text_c",
            "target": "utilization_target_c",
            "adj_target": "adjusted_utilization_target_c",
            "price": "resource_blp_c",
            "billable_hours": "pse_historical_billable_hours_c",
            "calendar_hours": "pse_historical_calendar_hours_c",
            "last_modified": "last_modified_date",
            "time_period_type": "pse_time_period_type_c",
        },
        "utilization_summary": {"calc_id": "pse_utilization_calculation_c"},
    }


#: Columns that a source may lack; they are NULL then.
OPTIONAL = ("calc_hist_util", "calc_sched_util")


def quoted(name: str) -> str:
    """An identifier in SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def conform_sql(
    source: T.StructType, schema: T.StructType, names: Mapping[str, str] | None = None
) -> list[str]:
    """SQL of the columns of ``schema`` over a source with the given columns; see `conform`."""
    names = names or {}
    have = {field.name.lower(): field.dataType for field in source.fields}
    columns = []
    for field in schema.fields:
        name = names.get(field.name, field.name)
        wanted = field.dataType.simpleString()
        if field.name in OPTIONAL and name.lower() not in have:
            columns.append(f"cast(NULL AS {wanted}) AS {field.name}")
            continue
        column, kind = quoted(name), have.get(name.lower())
        if field.dataType == _NUMBER:
            if kind is not None and not isinstance(kind, T.NumericType):
                column = f"try_cast({column} AS double)"
        elif kind != field.dataType:
            column = f"try_cast({column} AS {wanted})"
        columns.append(f"{column} AS {field.name}")
    return columns


def conform(
    df: DataFrame, schema: T.StructType, names: Mapping[str, str] | None = None
) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; columns already of the type stay uncast.

    Numbers keep the type and precision they have; numbers given as text become doubles.
    """
    return df.selectExpr(*conform_sql(df.schema, schema, names))
