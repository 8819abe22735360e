"""The base tables derived from the test tables: orders become deals, line items their history.

Deterministic projections; see FIXTURES.md for the mapping and what it exercises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealtide.sources.tables import Tables

# Practices by number; numbers beyond the end have none.
PRACTICES = (
    "Data", "Data (L2)", "Data Protection", "Public Cloud", "AppDev", "Application Svc",
    "Advisory", "EMA", "ESM", "MS - Security", "Modern Infrastructure", "Network", "Security",
)
STAFF = (
    "Data", "Next Gen Data Center", "Digital Solutions", "Public Cloud", "AppDev", "Mod Infra",
    "Advisory", "EMA", "ESM", "MS - Security", "DevOps", "Network", "Security", "TSA", "Other Team",
)
# Four decimals.
_FRACTION = "cast(l_discount AS decimal(4,2)) * cast(l_tax AS decimal(4,2))"
STAGES = ("Prospecting/Lead", "Pipeline", "Upside", "Strong Upside", "Commit")


def sample_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    recipes = {
        "opportunity": (opportunity, "orders"),
        "opportunity_field_history": (opportunity_field_history, "lineitem"),
        "wbs": (wbs, "lineitem", "part"),
        "resource_request": (resource_request, "orders"),
        "resource_request_history": (resource_request_history, "lineitem"),
        "resource_actuals": (resource_actuals, "customer"),
        "utilization_calculation": (utilization_calculation, "lineitem"),
        "utilization_detail": (utilization_detail, "lineitem", "part"),
        "utilization_summary": (utilization_summary, "lineitem"),
    }

    def load(name: str) -> DataFrame:
        derive, *sources = recipes[name]
        return derive(*map(read, sources))

    return Tables(load)


def _choose(names: tuple[str, ...], index: str) -> str:
    return f"get(array({', '.join(map(repr, names))}), cast({index} AS int))"


def _listed_again(rows: DataFrame, test: str) -> DataFrame:
    """Rows that pass come twice: an export that repeats some ids."""
    return rows.selectExpr("*", f"explode(if({test}, array(1, 2), array(1))) AS copy")


def opportunity(orders: DataFrame) -> DataFrame:
    return _listed_again(orders, "o_orderkey % 50 = 0").selectExpr(
        "*",
        "o_orderstatus IN ('F', 'O') AS is_closed",
        "o_orderstatus = 'F' AND o_custkey % 16 <> 11 AS is_won",
    ).selectExpr(
        "cast(o_orderkey AS string) AS id",
        "concat('OPP-', o_orderkey) AS name",
        f"{_choose(PRACTICES, 'o_custkey % 16')} AS practice",
        f"{_choose(PRACTICES, '(o_custkey + 1) % 16')} AS practice_2",
        "o_orderdate AS created_date",
        """date_add(cast(o_orderdate AS date),
                    cast(if(o_orderkey % 97 = 0, 3000, (o_custkey * 7 + o_orderkey * 13) % 400) AS int))
           AS close_date""",
        """CASE WHEN o_orderkey % 200 = 0 THEN 'Closed Duplicate'
                WHEN is_won THEN 'Closed Won'
                WHEN is_closed AND o_orderkey % 11 = 0 THEN 'Closed - Duplicate'
                WHEN is_closed THEN 'Closed Lost'
                WHEN o_orderpriority = '1-URGENT' THEN 'Commit'
                ELSE 'Pipeline' END AS stage_name""",
        "is_won",
        "is_closed",
        "cast(o_custkey % 20 AS string) AS created_by_id",
        "if(o_orderkey % 3 = 0, 'Price', NULL) AS reason_code",
        "concat('J', o_orderkey) AS job_id",
        "quarter(o_orderdate) AS fiscal_quarter",
        "year(o_orderdate) AS fiscal_year",
        "cast(o_custkey % 5 AS string) AS territory",
    )


def opportunity_field_history(items: DataFrame) -> DataFrame:
    return items.selectExpr(
        "*",
        "date_add(cast(l_shipdate AS date), cast(l_quantity AS int) - 5) AS old_close",
        "cast(l_partkey % 60 - 10 AS int) AS shift",
    ).selectExpr(
        "cast(l_orderkey AS string) AS opportunity_id",
        "l_shipdate + make_dt_interval(0, cast(l_partkey % 24 AS int)) AS created_date",
        "CASE l_returnflag WHEN 'R' THEN 'StageName' WHEN 'A' THEN 'CloseDate' ELSE 'Amount' END AS field",
        "if(l_returnflag = 'A', cast(old_close AS string), 'x') AS old_value",
        f"""if(l_returnflag = 'A', cast(date_add(old_close, shift) AS string),
               coalesce({_choose(STAGES, "l_linenumber - 1")}, 'Closed')) AS new_value""",
    )


def wbs(items: DataFrame, parts: DataFrame) -> DataFrame:
    return items.join(parts, items.l_partkey == parts.p_partkey).selectExpr(
        "cast(l_orderkey AS string) AS opportunity_id",
        "cast(trunc(l_shipdate, 'year') AS timestamp_ntz) AS created_date",
        """CASE p_type WHEN 'PROMO' THEN 'Data Engineer' WHEN 'LARGE' THEN 'Senior Data Consultant'
                WHEN 'ECONOMY' THEN 'Data Contractor' WHEN 'SMALL' THEN 'Data Protection Consultant'
                ELSE 'Cloud Consultant' END AS role""",
        f"cast(cast(l_quantity AS int) - 1 + {_FRACTION} AS decimal(14,4)) AS hours",
    )


def resource_request(orders: DataFrame) -> DataFrame:
    return _listed_again(orders, "o_orderkey % 60 = 0").selectExpr(
        "cast(o_orderkey AS string) AS id",
        "cast(o_orderkey AS string) AS opportunity_id",
        "cast(o_custkey AS string) AS resource_id",
        f"{_choose(PRACTICES, 'o_custkey % 16')} AS practice",
        "cast(o_orderkey % 4 AS string) AS role",
        "o_orderdate AS created_date",
    )


def resource_request_history(items: DataFrame) -> DataFrame:
    return items.selectExpr(
        "concat(if(l_orderkey % 9 = 0, 'none-', ''), l_orderkey) AS parent_id",
        "l_shipdate AS created_date",
        """CASE l_returnflag WHEN 'R' THEN 'pse__Resource_Held__c'
                WHEN 'A' THEN 'pse__Staffer_Resource__c' ELSE 'pse__Status__c' END AS field""",
        "if(l_linestatus = 'O', 'true', 'false') AS old_value",
        "if(l_partkey % 2 = 0, 'Jane Doe', 'a0X1') AS new_value",
    )


def resource_actuals(customers: DataFrame) -> DataFrame:
    return (
        customers.selectExpr("*", "explode(array(c_mktsegment, 'alt')) AS tail").selectExpr(
            "concat(if(c_custkey % 10 = 0, 'none-', ''), c_custkey) AS resource_id",
            "concat(c_name, ' - ', tail) AS name",
        )
    )


def utilization_calculation(items: DataFrame) -> DataFrame:
    return (
        items.selectExpr("year(l_shipdate) AS y", "month(l_shipdate) AS m")
        .distinct()
        .selectExpr("*", "explode(array('Historical', 'Scheduled')) AS kind")
        .selectExpr(
            "*",
            "cast(y * 100 + m + if(kind = 'Scheduled', 1000000, 0) AS string) AS id",
            "make_date(y, m, 28) AS end",
        )
        .selectExpr(
            "id",
            "if((y + m) % 13 <> 0, id, NULL) AS time_period_id",
            "concat('ACS_', kind, '_Monthly_', y, '_', m) AS name",
            "'Month' AS time_period_type",
            "end AS sched_end",
            "if((y + m) % 9 <> 0, end, NULL) AS hist_end",
            "kind = 'Historical' AS calc_hist_util",
            "kind = 'Scheduled' AS calc_sched_util",
            "(y * 12 + m) % 17 = 0 AS is_deleted",
        )
    )


_CALC_ID = """cast(year(l_shipdate) * 100 + month(l_shipdate) + if(l_linenumber = 7, 1000000, 0) AS string)
              AS calc_id"""


def utilization_detail(items: DataFrame, parts: DataFrame) -> DataFrame:
    return items.join(parts, items.l_partkey == parts.p_partkey).selectExpr(
        _CALC_ID,
        "cast(l_suppkey AS string) AS resource_id",
        """CASE p_type WHEN 'PROMO' THEN 'Consultant: Data' WHEN 'LARGE' THEN 'Senior Consultant - Cloud'
                WHEN 'ECONOMY' THEN 'Managing Principle' WHEN 'SMALL' THEN 'Managing Principal'
                WHEN 'MEDIUM' THEN 'Engineer II' ELSE 'Intern' END AS role""",
        f"{_choose(STAFF, 'l_suppkey % 16')} AS practice",
        f"cast(if(l_linenumber = 6, 0, p_size + {_FRACTION}) AS decimal(14,4)) AS target",
        f"cast(if(p_size % 10 = 0, 0, p_size + 5 + {_FRACTION}) AS decimal(14,4)) AS adj_target",
        # Price per unit in ten-thousandths, rounded in integers.
        """cast(((200 * cast(round(l_extendedprice * 100) AS bigint) + cast(l_quantity AS bigint))
                 div (2 * cast(l_quantity AS bigint))) * 0.0001BD AS decimal(14,4)) AS price""",
        f"cast(cast(l_quantity AS int) + {_FRACTION} AS decimal(14,4)) AS billable_hours",
        "cast(if(l_tax = 0, 0, 50 + cast(l_discount AS decimal(4,2))) AS decimal(14,4)) AS calendar_hours",
        "l_shipdate AS last_modified",
        "if(l_linenumber = 4, 'Week', 'Month') AS time_period_type",
        "l_linenumber = 5 AS is_deleted",
    )


def utilization_summary(items: DataFrame) -> DataFrame:
    return items.selectExpr(_CALC_ID, "l_shipdate AS created_date").distinct()
