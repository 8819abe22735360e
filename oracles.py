"""Independent SQL for every registered query, in the dialect of DuckDB.

The statements follow the plain definition of each report (separate numerators and
denominators, self joins, row windows), where the library folds the same work into one
aggregation, so that the two check each other. Rounded values are computed in integers on
both sides; see dealtide/functions/exact.py.
"""

from __future__ import annotations

from textwrap import dedent

MIN_YEAR = 1998
AS_OF = "DATE '2001-06-30'"
YEAR = 1999

_PRACTICES = (
    "['Data','Data (L2)','Data Protection','Public Cloud','AppDev','Application Svc','Advisory',"
    "'EMA','ESM','MS - Security','Modern Infrastructure','Network','Security']"
)
_STAFF = (
    "['Data','Next Gen Data Center','Digital Solutions','Public Cloud','AppDev','Mod Infra','Advisory',"
    "'EMA','ESM','MS - Security','DevOps','Network','Security','TSA','Other Team']"
)

# ---------------------------------------------------------------- base tables

# Numbers with four decimals are held in ten-thousandths.
FRACTION = "round(l_discount * 100)::BIGINT * round(l_tax * 100)::BIGINT"

BASE = {
    "deal": f"""
        SELECT o_orderkey::VARCHAR AS id,
               'OPP-' || o_orderkey AS name,
               {_PRACTICES}[o_custkey % 16 + 1] AS practice,
               {_PRACTICES}[(o_custkey + 1) % 16 + 1] AS practice_2,
               o_orderdate AS created_date,
               o_orderdate::DATE + (CASE WHEN o_orderkey % 97 = 0 THEN 3000
                   ELSE (o_custkey * 7 + o_orderkey * 13) % 400 END)::INTEGER AS close_date,
               CASE WHEN o_orderkey % 200 = 0 THEN 'Closed Duplicate'
                    WHEN o_orderstatus = 'F' AND o_custkey % 16 <> 11 THEN 'Closed Won'
                    WHEN o_orderstatus IN ('F','O') AND o_orderkey % 11 = 0 THEN 'Closed - Duplicate'
                    WHEN o_orderstatus IN ('F','O') THEN 'Closed Lost'
                    WHEN o_orderpriority = '1-URGENT' THEN 'Commit'
                    ELSE 'Pipeline' END AS stage_name,
               o_orderstatus = 'F' AND o_custkey % 16 <> 11 AS is_won,
               o_orderstatus IN ('F','O') AS is_closed,
               (o_custkey % 20)::VARCHAR AS created_by_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Price' END AS reason_code,
               'J' || o_orderkey AS job_id,
               quarter(o_orderdate)::INTEGER AS fiscal_quarter,
               year(o_orderdate)::INTEGER AS fiscal_year,
               (o_custkey % 5)::VARCHAR AS territory
        FROM orders, (VALUES (1), (2)) AS copies(copy) WHERE copy = 1 OR o_orderkey % 50 = 0""",
    "change": """
        SELECT l_orderkey::VARCHAR AS deal_id,
               l_shipdate + to_hours((l_partkey % 24)::INTEGER) AS ts,
               CASE l_returnflag WHEN 'R' THEN 'StageName' WHEN 'A' THEN 'CloseDate' ELSE 'Amount' END AS field,
               CASE WHEN l_returnflag = 'A'
                    THEN strftime(l_shipdate::DATE + (l_quantity - 5)::INTEGER, '%Y-%m-%d')
                    ELSE 'x' END AS old_value,
               CASE WHEN l_returnflag = 'A'
                    THEN strftime(l_shipdate::DATE + (l_quantity - 5 + l_partkey % 60 - 10)::INTEGER, '%Y-%m-%d')
                    ELSE coalesce(['Prospecting/Lead','Pipeline','Upside','Strong Upside','Commit'][l_linenumber],
                                  'Closed') END AS new_value
        FROM lineitem""",
    "plan": f"""
        SELECT l_orderkey::VARCHAR AS deal_id,
               date_trunc('year', l_shipdate)::TIMESTAMP AS ts,
               CASE p_type WHEN 'PROMO' THEN 'Data Engineer' WHEN 'LARGE' THEN 'Senior Data Consultant'
                    WHEN 'ECONOMY' THEN 'Data Contractor' WHEN 'SMALL' THEN 'Data Protection Consultant'
                    ELSE 'Cloud Consultant' END AS role,
               (l_quantity - 1)::BIGINT * 10000 + {FRACTION} AS units
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "request": f"""
        SELECT o_orderkey::VARCHAR AS id, o_orderkey::VARCHAR AS deal_id, o_custkey::VARCHAR AS resource_id,
               {_PRACTICES}[o_custkey % 16 + 1] AS practice, (o_orderkey % 4)::VARCHAR AS role,
               o_orderdate AS requested
        FROM orders, (VALUES (1), (2)) AS copies(copy) WHERE copy = 1 OR o_orderkey % 60 = 0""",
    "request_change": """
        SELECT CASE WHEN l_orderkey % 9 = 0 THEN 'none-' ELSE '' END || l_orderkey AS request_id, l_shipdate AS ts,
               CASE l_returnflag WHEN 'R' THEN 'pse__Resource_Held__c' WHEN 'A' THEN 'pse__Staffer_Resource__c'
                    ELSE 'pse__Status__c' END AS field,
               CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END AS old_value,
               CASE WHEN l_partkey % 2 = 0 THEN 'Jane Doe' ELSE 'a0X1' END AS new_value
        FROM lineitem""",
    "person": """
        SELECT CASE WHEN c_custkey % 10 = 0 THEN 'none-' ELSE '' END || c_custkey AS resource_id, c_name || ' - ' || tail AS name
        FROM customer, (VALUES (1), (2)) AS copies(copy),
             LATERAL (SELECT CASE copy WHEN 1 THEN c_mktsegment ELSE 'alt' END AS tail)""",
    "calc": """
        SELECT (y * 100 + m + k * 1000000)::VARCHAR AS id,
               CASE WHEN (y + m) % 13 <> 0 THEN y * 100 + m + k * 1000000 END AS period_id,
               CASE k WHEN 0 THEN 'ACS_Historical_Monthly_' ELSE 'ACS_Scheduled_Monthly_' END || y || '_' || m AS name,
               make_date(y, m, 28) AS sched_end,
               CASE WHEN (y + m) % 9 <> 0 THEN make_date(y, m, 28) END AS hist_end,
               (y * 12 + m) % 17 = 0 AS is_deleted
        FROM (SELECT DISTINCT year(l_shipdate) AS y, month(l_shipdate) AS m FROM lineitem),
             (VALUES (0), (1)) AS kinds(k)""",
    "detail": f"""
        SELECT (year(l_shipdate) * 100 + month(l_shipdate)
                + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END)::VARCHAR AS calc_id,
               l_suppkey::VARCHAR AS resource_id,
               CASE p_type WHEN 'PROMO' THEN 'Consultant: Data' WHEN 'LARGE' THEN 'Senior Consultant - Cloud'
                    WHEN 'ECONOMY' THEN 'Managing Principle' WHEN 'SMALL' THEN 'Managing Principal'
                    WHEN 'MEDIUM' THEN 'Engineer II' ELSE 'Intern' END AS role,
               {_STAFF}[l_suppkey % 16 + 1] AS practice,
               CASE WHEN l_linenumber = 6 THEN 0 ELSE p_size * 10000 + {FRACTION} END AS target,
               CASE WHEN p_size % 10 = 0 THEN 0 ELSE (p_size + 5) * 10000 + {FRACTION} END AS adj_target,
               (200 * round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT) AS price,
               l_quantity::BIGINT * 10000 + {FRACTION} AS billable,
               CASE WHEN l_tax = 0 THEN 0 ELSE 500000 + 100 * round(l_discount * 100)::BIGINT END AS calendar,
               l_shipdate AS last_modified,
               l_linenumber = 4 AS weekly,
               l_linenumber = 5 AS is_deleted
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
}
BASE["summary"] = "SELECT DISTINCT calc_id, last_modified AS ts FROM detail"

# ------------------------------------------------------------------- helpers


def half_away(num: str, den: str, places: int, scale: str | None = None) -> str:
    """num / den rounded half away from zero to ``places``, as a double; both are integers."""
    scale = scale or f"{10**places}.0"
    n, d = f"({num})::HUGEINT", f"nullif({den}, 0)::HUGEINT"
    units = f"(({2 * 10**places} * abs({n}) + {d}) // (2 * {d}))"
    return f"(CASE WHEN ({num}) < 0 THEN -{units} ELSE {units} END::DOUBLE / {scale}::DOUBLE)"


def share(part: str, whole: str) -> str:
    return half_away(f"nullif({part}, 0)", whole, 3, "10.0")


def cases(column: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"{column} ILIKE '{p}'" for p in patterns.split("|")) + f" THEN '{label}'"
        for patterns, label in rules
    )
    return f"CASE {arms} ELSE {otherwise} END"


# Label rules in order of precedence; below, stage tests, field names and bucket names.
DEAL_LABEL = cases(
    "practice",
    [
        ("%advisory%", "Advisory"),
        ("%appdev%|%application%", "AppDev"),
        ("%cloud%", "Cloud"),
        ("%data protection%", "Data Protection"),
        ("%data%", "Data"),
        ("%ema%", "EMA"),
        ("%esm%", "ESM"),
        ("%euc%", "EUC"),
        ("%ms%|%managed%", "Managed Services"),
        ("%modern%", "Modern Infrastructure"),
        ("%network%", "Network"),
        ("%security%", "Security"),
    ],
    "'Null'",
)
STAFF_LABEL = cases(
    "practice",
    [
        ("%advisory%", "Advisory"),
        ("%appdev%|%application%", "AppDev"),
        ("%cloud%", "Cloud"),
        ("%next gen data%", "Next Gen Data Center PMs"),
        ("%digital solutions%", "Digital Solutions PMs"),
        ("%data%", "Data"),
        ("%ema%", "EMA"),
        ("%esm%", "ESM"),
        ("%euc%", "EUC"),
        ("%ms%|%managed%", "Managed Services"),
        ("%mod%", "Modern Infrastructure"),
        ("%network%", "Network"),
        ("%security%", "Security"),
        ("%devops%", "DevOps"),
        ("%tsa%", "TSA"),
        ("products", "Products"),
    ],
    "practice",
)
ROLE_LABEL = cases(
    "resource_role",
    [
        ("associate technical%", "Associate Technical Consultant"),
        ("consultant:%", "Consultant"),
        ("delivery manager%", "Delivery Manager"),
        ("engineer%", "Engineer"),
        ("managing principle%", "Managing Principal"),
        ("principal consultant%", "Principal Consultant"),
        ("principal technical consultant%", "Principal Technical Consultant"),
        ("program manager%", "Program Manager"),
        ("project manager%", "Project Manager"),
        ("senior associate technical%", "Senior Associate Technical Consultant"),
        ("senior consultant%", "Senior Consultant"),
        ("senior technical consultant%", "Senior Technical Consultant"),
        ("team lead%", "Team Lead"),
        ("technical consultant%", "Technical Consultant"),
    ],
    "NULL",
)

STAGE_TESTS = {
    "prospecting_lead": "stage LIKE '%prospecting%lead%'",
    "pipeline": "stage = 'pipeline'",
    "upside": "stage = 'upside'",
    "strong_upside": "stage = 'strong upside'",
    "committed": "stage LIKE '%commit%'",
}

IS_DATA = "lower(practice) IN ('data', 'data (l2)')"
CREATED = "year(created_date)::INTEGER"
WON = "is_closed AND is_won"
RECENT_YEARS = f"close_date <= {AS_OF} AND year({AS_OF}) - year(close_date) <= 2"
RECENT_QUARTERS = (
    f"close_date <= {AS_OF} AND (year({AS_OF}) * 4 + quarter({AS_OF}))"
    " - (year(close_date) * 4 + quarter(close_date)) <= 3"
)


def statement(base: str, body: str, **ctes: str) -> str:
    """A statement over the named base tables, further CTEs, and the final body."""
    named = {name: BASE[name] for name in base.split()} | ctes
    parts = ",\n".join(f"{name} AS ({dedent(sql).strip()})" for name, sql in named.items())
    return f"WITH {parts}\n{dedent(body).strip()}"


# --------------------------------------------------------------- A. the funnel


def win_rate(where: str) -> str:
    return statement(
        "deal",
        f"""
        SELECT closed.y AS year_opp_created, {share("w", "c")} AS opp_to_win_percent
        FROM closed LEFT JOIN winners ON winners.y = closed.y""",
        closed=f"""
        SELECT {CREATED} AS y, count(*) AS c FROM deal
        WHERE is_closed AND lower(stage_name) NOT LIKE '%duplicate%' AND {where} GROUP BY 1""",
        winners=f"SELECT {CREATED} AS y, count(*) AS w FROM deal WHERE {WON} AND {where} GROUP BY 1",
    )


def stage_days(where: str, key_sql: str, keys: str, extra: str = "") -> str:
    averages = ", ".join(
        half_away(
            f"sum(close_date - ts::DATE) FILTER (WHERE {test})", f"count(*) FILTER (WHERE {test})", 1
        )
        + f" AS {name}_avg_days_till_close"
        for name, test in STAGE_TESTS.items()
    )
    return statement(
        "deal change",
        f"""
        SELECT {keys}, {extra} {averages}
        FROM staged, (SELECT avg(total) AS mu, stddev_samp(total) AS sd FROM staged)
        WHERE total BETWEEN mu - 3 * sd AND mu + 3 * sd GROUP BY {keys}""",
        staged=f"""
        SELECT id, close_date, ts, lower(new_value) AS stage,
               close_date - created_date::DATE AS total, {key_sql},
               greatest({", ".join(f"CASE WHEN {test} THEN {i + 1} ELSE 0 END" for i, test in enumerate(STAGE_TESTS.values()))}) AS furthest
        FROM change JOIN deal ON id = deal_id
        WHERE {WON} AND close_date - created_date::DATE > 1 AND lower(field) = 'stagename' AND {where}
        QUALIFY row_number() OVER (PARTITION BY id, ts::DATE
            ORDER BY ts DESC, furthest DESC) = 1""",
    )


def since(year: int) -> str:
    return f"year(created_date) >= {year}"


FUNNEL = {
    "practice_names_like": statement(
        "deal",
        "SELECT DISTINCT practice AS data_practice_names FROM deal WHERE practice ILIKE '%data%'",
    ),
    "practice_names_like_secondary": statement(
        "deal",
        "SELECT DISTINCT practice_2 AS secondary_practice FROM deal WHERE practice_2 ILIKE '%data%'",
    ),
    "practice_opps": statement(
        "deal",
        f"""
        SELECT name, practice, created_date, fiscal_quarter, fiscal_year, stage_name, is_won, is_closed,
               close_date, territory AS parent_territory
        FROM deal WHERE {IS_DATA}""",
    ),
    "opps_by_practice": statement(
        "deal", "SELECT practice, count(*) AS num_opps FROM deal GROUP BY practice"
    ),
    "null_practice_share_by_creator": statement(
        "deal",
        f"""
        SELECT who AS opps_created_by_id, n.y AS opps_year_created, k AS num_opp_w_practice_null,
               total AS yearly_total_num_opp_w_practice_null,
               {share("k", "total")} AS yearly_percent_share_of_nulls_created
        FROM (SELECT created_by_id AS who, y, count(*) AS k FROM blank GROUP BY ALL HAVING count(*) >= 10) AS n
        LEFT JOIN (SELECT y, count(*) AS total FROM blank GROUP BY y) AS t ON t.y = n.y
        ORDER BY k DESC, who ASC NULLS LAST, n.y LIMIT 10""",
        blank=f"SELECT *, {CREATED} AS y FROM deal WHERE practice IS NULL AND {since(MIN_YEAR)}",
    ),
    "null_practice_excluding_bulk_creators": statement(
        "deal",
        """
        SELECT count(*) AS num_opps_w_practice_field_nulls,
               (SELECT count(who) FROM bulk) AS num_creator_ids_omitted
        FROM blank WHERE created_by_id NOT IN (SELECT who FROM bulk)""",
        blank=f"SELECT * FROM deal WHERE practice IS NULL AND {since(MIN_YEAR)}",
        bulk="""
        SELECT DISTINCT created_by_id AS who FROM blank
        GROUP BY created_by_id, created_date::DATE HAVING count(*) >= 3""",
    ),
    "null_practice_by_year": statement(
        "deal",
        f"""
        SELECT count(*) AS num_practice_field_nulls_per_year, {CREATED} AS year_opp_created
        FROM deal WHERE practice IS NULL AND {since(MIN_YEAR)} GROUP BY 2""",
    ),
    "win_rate_by_year": win_rate(since(MIN_YEAR)),
    "win_rate_by_year_for_practice": win_rate(IS_DATA),
    "days_to_close_stats": statement(
        "deal",
        f"""
        SELECT median(d)::DOUBLE AS median_days_to_close, {half_away("sum(d)", "count(*)", 1)} AS avg_days_to_close
        FROM spans, (SELECT avg(d) AS mu, stddev_samp(d) AS sd FROM spans)
        WHERE d BETWEEN mu - 3 * sd AND mu + 3 * sd""",
        spans=f"""
        SELECT close_date - created_date::DATE AS d FROM deal
        WHERE {WON} AND {IS_DATA} AND close_date - created_date::DATE > 1""",
    ),
    "stage_days_to_close_by_year": stage_days(
        since(MIN_YEAR), f"{CREATED} AS year_opp_created", "year_opp_created"
    ),
    "stage_days_to_close_by_year_for_practice": stage_days(
        f"{since(MIN_YEAR)} AND {IS_DATA}", f"{CREATED} AS year_opp_created", "year_opp_created"
    ),
    "quick_wins_by_year": statement(
        "deal",
        f"""
        SELECT {CREATED} AS year_opp_created, count(*) AS num_opps_0_or_1days_create_to_close
        FROM deal WHERE {WON} AND {IS_DATA} AND close_date - created_date::DATE BETWEEN 0 AND 1 GROUP BY 1""",
    ),
    "loss_reason_rate": statement(
        "deal",
        f"""
        SELECT a.y AS year_opp_created, {share("r", "n")} AS reason_for_opp_closing_provided_percent
        FROM (SELECT y, count(*) AS n FROM gone GROUP BY y) AS a
        LEFT JOIN (SELECT y, count(*) AS r FROM gone WHERE reason_code IS NOT NULL GROUP BY y) AS b USING (y)""",
        gone=f"SELECT *, {CREATED} AS y FROM deal WHERE is_closed AND NOT is_won AND {since(MIN_YEAR)}",
    ),
}

# ---------------------------------------------------------- B. change history


def changes_per_deal(field: str, name: str, where: str = "true") -> str:
    return statement(
        "deal change",
        f"""
        SELECT y AS year_opp_created, {half_away("n", "d", 1)} AS {name}
        FROM (SELECT y, count(*) AS n FROM day GROUP BY y) JOIN (SELECT y, count(id) AS d FROM winner GROUP BY y)
        USING (y)""",
        winner=f"SELECT id, {CREATED} AS y FROM deal WHERE {WON} AND {since(MIN_YEAR)} AND {where}",
        day=f"""
        SELECT DISTINCT id, y, ts::DATE AS d FROM change JOIN winner ON id = deal_id
        WHERE lower(field) = '{field}'""",
    )


def movement(where: str = "true") -> str:
    def bucket(column: str, test: str, name: str) -> str:
        return f"count(*) FILTER (WHERE {column} {test}) AS {name}"

    return statement(
        "deal change",
        """
        SELECT y AS year_opp_created, changed + unchanged AS num_unique_opps,
               unchanged AS num_opps_w_unchanged_closedate, moved.* EXCLUDE (y, changed)
        FROM moved JOIN still USING (y)""",
        staged=f"""
        SELECT id, {CREATED} AS y, ts, ts::DATE AS d, lower(field) AS field, old_value, new_value
        FROM change JOIN deal ON id = deal_id WHERE {WON} AND {since(MIN_YEAR)} AND {where}""",
        still="""
        SELECT y, count(DISTINCT id) AS unchanged FROM staged
        WHERE id NOT IN (SELECT id FROM staged WHERE field = 'closedate') GROUP BY y""",
        first_of_day="""
        SELECT id, y, d, try_cast(old_value AS DATE) - d AS lead,
               try_cast(new_value AS DATE) - try_cast(old_value AS DATE) AS shift,
               CASE WHEN lead <= 0 THEN 0 WHEN lead <= 7 THEN 1 WHEN lead <= 30 THEN 2 WHEN lead > 30 THEN 3 ELSE 4 END AS lead_bucket,
               CASE WHEN shift <= 0 THEN 0 WHEN shift <= 7 THEN 1 WHEN shift <= 30 THEN 2 WHEN shift > 30 THEN 3 ELSE 4 END AS shift_bucket
        FROM staged WHERE field = 'closedate'
        QUALIFY row_number() OVER (PARTITION BY id, d
            ORDER BY ts, lead_bucket, shift_bucket) = 1""",
        moved="SELECT y, count(DISTINCT id) AS changed, "
        + ", ".join(
            [
                bucket("lead", "<= 0", "num_opps_closedate_changed_on_or_after_close"),
                bucket("lead", "BETWEEN 1 AND 7", "num_opps_closedate_changed_within_oneweek_from_close"),
                bucket("lead", "BETWEEN 8 AND 30", "num_opps_closedate_changed_within_onemonth_from_close"),
                bucket("lead", "> 30", "num_opps_closedate_changed_more_than_onemonth_from_close"),
                bucket("shift", "<= 0", "num_opps_closedate_pulled_ahead"),
                bucket("shift", "BETWEEN 1 AND 7", "num_opps_closedate_changedby_oneweek_orless"),
                bucket("shift", "BETWEEN 8 AND 30", "num_opps_closedate_changedby_onemonth_orless"),
                bucket("shift", "> 30", "num_opps_closedate_changedby_morethan_onemonth"),
            ]
        )
        + " FROM first_of_day GROUP BY y",
    )


HISTORY = {
    "closedate_changes_per_opp": changes_per_deal("closedate", "avg_closedate_changes_per_opp"),
    "closedate_changes_per_opp_for_practice": changes_per_deal(
        "closedate", "avg_closedate_changes_per_opp", IS_DATA
    ),
    "stage_changes_per_opp": changes_per_deal("stagename", "avg_stagename_changes_per_opp"),
    "stage_changes_per_opp_for_practice": changes_per_deal(
        "stagename", "avg_stagename_changes_per_data_opp", IS_DATA
    ),
    "closedate_movement": movement(),
    "closedate_movement_for_practice": movement(IS_DATA),
}

# ------------------------------------------------------------ C. planned hours


def planned(where: str, select: str, roles: str = "true") -> str:
    return statement(
        "deal plan",
        select,
        entered=f"""
        SELECT deal_id, ts, role, units, practice, {CREATED} AS y, close_date
        FROM deal JOIN plan ON deal_id = id WHERE {WON} AND units <> 0 AND {where}""",
        newest=f"""
        SELECT entered.* FROM entered
        JOIN (SELECT deal_id, max(ts) AS ts FROM entered GROUP BY deal_id) AS latest
          ON latest.deal_id = entered.deal_id AND latest.ts = entered.ts
        WHERE {roles}""",
    )


MEAN_HOURS = half_away("sum(units)", "10000 * count(units)", 1) + " AS avg_hours_per_opp"
DATA_ROLES = "role ILIKE '%data%' AND role NOT ILIKE '%contractor%' AND role NOT ILIKE '%protection%'"

WBS = {
    "wbs_hours_by_practice": planned(
        since(MIN_YEAR),
        f"""
        SELECT y AS year_opp_created, practice, {MEAN_HOURS}, count(DISTINCT deal_id) AS num_opps
        FROM newest GROUP BY y, practice""",
    ),
    "wbs_hours_for_practice": planned(
        f"{since(MIN_YEAR)} AND {IS_DATA}",
        f"""
        SELECT y AS year_opp_created, {MEAN_HOURS}, count(DISTINCT deal_id) AS num_opps
        FROM newest GROUP BY y""",
        DATA_ROLES,
    ),
    "wbs_hours_by_role": planned(
        f"{since(MIN_YEAR)} AND {IS_DATA}",
        f"""
        SELECT y AS year_opp_created, role AS consultant_type, {MEAN_HOURS}
        FROM newest GROUP BY y, role""",
        DATA_ROLES,
    ),
}

# --------------------------------------------------------- D. dashboard views

CLOSE_KEYS = (
    f"{DEAL_LABEL} AS label, year(close_date)::INTEGER AS cy, quarter(close_date)::INTEGER AS cq"
)
CLOSE_NAMES = (
    f"{DEAL_LABEL} AS practice_label, year(close_date)::INTEGER AS year_opp_closed,"
    " quarter(close_date)::INTEGER AS quarter_opp_closed"
)

WIN_BY_QUARTER = f"""
    SELECT d.label AS practice, n.cy AS year_opp_closed, n.cq AS quarter_opp_closed, w AS won_opps,
           c AS all_closed_opps, c - w AS lost_opps, {share("w", "c")} AS opp_win_percent
    FROM (SELECT label, cy, cq, count(*) AS c FROM recent
          WHERE is_closed AND stage_name NOT ILIKE '%duplicate%' GROUP BY ALL) AS d
    LEFT JOIN (SELECT label, cy, cq, count(*) AS w FROM recent WHERE {WON} GROUP BY ALL) AS n
      ON n.label = d.label AND n.cy = d.cy AND n.cq = d.cq"""
RECENT = f"SELECT *, {CLOSE_KEYS} FROM deal WHERE {RECENT_YEARS}"
HOURS_BY_QUARTER = f"""
    SELECT year(close_date)::INTEGER AS year_opp_closed, quarter(close_date)::INTEGER AS quarter_opp_closed,
           label AS practice, {MEAN_HOURS}, count(DISTINCT deal_id) AS num_opps_w_wbs
    FROM (SELECT *, {DEAL_LABEL} AS label FROM newest)
    GROUP BY ALL HAVING label NOT ILIKE 'managed services'"""


def _renamed(sql: str) -> str:
    return f"SELECT * RENAME (practice_label AS practice) FROM ({sql})"


DASHBOARD = {
    "stage_days_by_practice_quarter": _renamed(
        stage_days(
            RECENT_QUARTERS,
            CLOSE_NAMES,
            "practice_label, year_opp_closed, quarter_opp_closed",
            "count(DISTINCT id) AS num_opps,",
        )
    ),
    "stage_days_by_practice_year": _renamed(
        stage_days(
            RECENT_YEARS,
            CLOSE_NAMES,
            "practice_label, year_opp_closed",
            "count(DISTINCT id) AS num_opps,",
        )
    ),
    "win_rate_by_practice_quarter": statement("deal", WIN_BY_QUARTER, recent=RECENT),
    "days_to_close_by_practice_year": statement(
        "deal",
        f"""
        SELECT label AS practice, cy AS year_opp_closed, count(*) AS num_opps_won,
               median(d)::DOUBLE AS median_days_to_close, {half_away("sum(d)", "count(*)", 1)} AS avg_days_to_close
        FROM spans, (SELECT avg(d) AS mu, stddev_samp(d) AS sd FROM spans)
        WHERE d BETWEEN mu - 3 * sd AND mu + 3 * sd GROUP BY label, cy""",
        spans=f"""
        SELECT {CLOSE_KEYS}, close_date - created_date::DATE AS d FROM deal
        WHERE {WON} AND close_date - created_date::DATE > 1 AND {RECENT_YEARS}""",
    ),
    "wbs_hours_by_practice_quarter": planned(RECENT_YEARS, HOURS_BY_QUARTER),
    "wbs_hours_and_win_rate": planned(
        RECENT_YEARS,
        f"""
        SELECT * FROM ({HOURS_BY_QUARTER}) FULL JOIN (WITH recent AS ({RECENT}) {WIN_BY_QUARTER})
        USING (practice, year_opp_closed, quarter_opp_closed)
        WHERE year_opp_closed IS NOT NULL AND quarter_opp_closed IS NOT NULL""",
    ),
}

# ------------------------------------------------------------ E. staff on hold

CHANGED = "lower(field) = 'pse__staffer_resource__c' AND new_value NOT LIKE '%0%'"
RELEASED = "lower(field) = 'pse__resource_held__c' AND try_cast(old_value AS BOOLEAN)"


def _walk(column: str) -> str:
    """A milestone as known at each event: NULL until its moment is reached."""
    return (
        f"max(CASE WHEN ts = {column} THEN ts END) OVER (PARTITION BY id ORDER BY ts"
        f" ROWS UNBOUNDED PRECEDING) AS {column}_seen"
    )


def held(where: str) -> dict[str, str]:
    """Every event of lost requests, with the days held as known at that event."""
    return {
        "staged": f"""
        SELECT request.*, job_id, close_date, ts, field, old_value, new_value
        FROM request JOIN deal ON deal.id = request.deal_id
        LEFT JOIN request_change ON request_id = request.id
        WHERE is_closed AND NOT is_won AND {where}
          AND resource_id IN (SELECT resource_id FROM person)""",
        "marked": f"""
        SELECT *, max(ts) FILTER (WHERE {CHANGED}) OVER w AS reassigned,
               min(ts) FILTER (WHERE {RELEASED}) OVER w AS freed_first,
               max(ts) FILTER (WHERE {RELEASED}) OVER w AS freed_last,
               max(ts) OVER w AS ended
        FROM staged WINDOW w AS (PARTITION BY id)""",
        "walked": f"""
        SELECT *, {_walk("reassigned")}, {_walk("freed_first")}, {_walk("freed_last")},
               CASE WHEN ts = ended THEN ts END AS ended_here,
               row_number() OVER (PARTITION BY id ORDER BY ts, field NULLS LAST, old_value NULLS LAST,
                                  new_value NULLS LAST) AS step
        FROM marked""",
        "judged": """
        SELECT *,
               CASE WHEN reassigned IS NOT NULL THEN
                    coalesce(freed_last_seen::DATE - reassigned_seen::DATE,
                             ended_here::DATE - reassigned_seen::DATE) END AS days_changed,
               CASE WHEN reassigned IS NULL THEN
                    coalesce(freed_first_seen::DATE - requested::DATE,
                             ended_here::DATE - requested::DATE) END AS days_unchanged
        FROM walked""",
    }


HELD_BASE = "deal request request_change person"
HELD_WHERE = f"year(close_date) >= {MIN_YEAR} AND close_date <= {AS_OF}"
HELD_COUNTS = (
    "count(DISTINCT id) AS num_resources_held_and_opp_lost,"
    " count(DISTINCT deal_id) AS num_opps_lost_w_resources_held"
    " FROM judged WHERE coalesce(days_changed, days_unchanged) >= 10"
)
CLOSE_QUARTER = (
    "year(close_date)::INTEGER AS year_opp_closed, 'Q' || quarter(close_date) AS qtr_opp_closed"
)

STAFFING = {
    "held_for_lost_by_quarter": statement(
        HELD_BASE, f"SELECT {CLOSE_QUARTER}, {HELD_COUNTS} GROUP BY ALL", **held(HELD_WHERE)
    ),
    "held_for_lost_by_practice_quarter": statement(
        HELD_BASE, f"SELECT practice, {CLOSE_QUARTER}, {HELD_COUNTS} GROUP BY ALL", **held(HELD_WHERE)
    ),
    "held_for_lost_by_role": statement(
        HELD_BASE,
        f"SELECT role AS resource_role, {HELD_COUNTS} GROUP BY ALL",
        **held(f"{HELD_WHERE} AND lower(request.practice) = 'data'"),
    ),
    "resource_request_audit": statement(
        HELD_BASE,
        f"""
        SELECT practice, job_id, id AS resource_req_id, requested AS resource_req_date, consultant_name,
               step AS order_of_events, ts AS resource_req_change_date, field, old_value, new_value,
               days_unchanged::INTEGER AS num_days_held__resource_never_changed,
               days_changed::INTEGER AS num_days_held__resource_changed,
               ended_here AS final_change_to_resource_request_date,
               coalesce(coalesce(days_changed, days_unchanged) >= 10, false) AS resource_held_and_opp_lost,
               {CLOSE_QUARTER}
        FROM judged LEFT JOIN (SELECT resource_id, split_part(min(name), ' - ', 1) AS consultant_name
                               FROM person GROUP BY resource_id) USING (resource_id)
        WHERE ({CHANGED}) OR lower(field) = 'pse__resource_held__c' OR ended_here IS NOT NULL""",
        **held(f"year(close_date) >= {MIN_YEAR}"),
    ),
    "real_resources": statement(
        "request person",
        """
        SELECT id, deal_id AS opportunity_id, resource_id, practice, role, requested AS created_date
        FROM request WHERE resource_id IN (SELECT resource_id FROM person)""",
    ),
}

# --------------------------------------------------------------- F. utilization

MASTER = f"""
    SELECT consultant_name, role AS resource_role, price / 10000.0::DOUBLE AS resource_price, price,
           {STAFF_LABEL} AS practice, split_part(calc.name, '_', 5) AS month,
           target / 10000.0::DOUBLE AS util_target, adj_target / 10000.0::DOUBLE AS adjusted_util_target, adj_target,
           {half_away("100 * billable", "calendar", 1)} AS effective_utilization,
           (2000 * billable + calendar) // (2 * nullif(calendar, 0)) AS tenths
    FROM detail LEFT JOIN calc ON calc.id = detail.calc_id
    LEFT JOIN (SELECT resource_id, split_part(min(name), ' - ', 1) AS consultant_name
               FROM person GROUP BY resource_id) USING (resource_id)
    WHERE NOT detail.is_deleted AND NOT weekly AND year(last_modified) = {YEAR}
      AND NOT calc.is_deleted AND period_id IS NOT NULL AND sched_end IS NOT NULL AND hist_end IS NOT NULL
      AND target > 0 AND adj_target > 0 AND calc.name ILIKE 'ACS_Historical_Monthly%'"""
UTILIZATION_AVERAGES = ", ".join(
    [
        half_away("100000 * sum(tenths) * count(adj_target)", "sum(adj_target) * count(tenths)", 1)
        + " AS percent_of_util_achieved",
        half_away("sum(adj_target)", "10000 * count(adj_target)", 1) + " AS average_utilization_target",
        half_away("sum(tenths)", "10 * count(tenths)", 1) + " AS average_utilization",
    ]
)


def utilization(body: str) -> str:
    return statement("calc detail person", body, master=MASTER)


UTILIZATION = {
    "master_utilization": utilization("SELECT * EXCLUDE (price, adj_target, tenths) FROM master"),
    "utilization_by_practice": utilization(
        f"""
        SELECT practice, {UTILIZATION_AVERAGES} FROM master WHERE practice IS NOT NULL
        GROUP BY practice HAVING avg(tenths) IS NOT NULL"""
    ),
    "utilization_by_practice_quarter": utilization(
        f"""
        SELECT practice, CASE WHEN month::INTEGER <= 3 THEN 'Q1' WHEN month::INTEGER <= 6 THEN 'Q2'
                              WHEN month::INTEGER <= 9 THEN 'Q3' WHEN month::INTEGER <= 12 THEN 'Q4' END AS quarter,
               {UTILIZATION_AVERAGES}
        FROM master WHERE practice IS NOT NULL GROUP BY ALL"""
    ),
    "utilization_by_role": utilization(
        f"""
        SELECT resource_roles, {half_away("sum(price)", "10000 * count(price)", 0)}
                   AS average_resource_price_usd,
               {UTILIZATION_AVERAGES}
        FROM (SELECT *, {ROLE_LABEL} AS resource_roles FROM master) WHERE resource_roles IS NOT NULL
        GROUP BY resource_roles"""
    ),
    "utilization_fact_join": statement(
        "calc detail summary person",
        """
        SELECT calc.id AS util_calc_id,
               (SELECT count(*) FROM detail AS d WHERE d.calc_id = calc.id) AS num_detail,
               (SELECT count(*) FROM summary AS s WHERE s.calc_id = calc.id) AS num_summary,
               count(*) AS num_fanout
        FROM calc JOIN detail ON detail.calc_id = calc.id JOIN summary ON summary.calc_id = calc.id
        JOIN person ON person.resource_id = detail.resource_id
        GROUP BY calc.id""",
    ),
}

# 'Month' sorts before 'Week', as false before true; texts are never null but the practice, which comes first then.
_DETAIL_ORDER = (
    "role, practice NULLS FIRST, target, adj_target, price, billable, calendar, last_modified, weekly, d.is_deleted"
)
UTILIZATION["utilization_fact_rows"] = statement(
    "calc detail summary person",
    f"""
    SELECT calc.id AS util_calc_id, d.resource_id, person.name AS resource_name,
           period_id::VARCHAR AS calc_time_period_id, calc.name AS calc_name, 'Month' AS calc_time_period_type,
           sched_end AS calc_sched_end, hist_end AS calc_hist_end,
           calc.name LIKE '%Historical%' AS calc_calc_hist_util, calc.name LIKE '%Scheduled%' AS calc_calc_sched_util,
           calc.is_deleted AS calc_is_deleted, role AS detail_role, practice AS detail_practice,
           target / 10000.0::DOUBLE AS detail_target, adj_target / 10000.0::DOUBLE AS detail_adj_target,
           price / 10000.0::DOUBLE AS detail_price, billable / 10000.0::DOUBLE AS detail_billable_hours,
           calendar / 10000.0::DOUBLE AS detail_calendar_hours, last_modified AS detail_last_modified,
           CASE WHEN weekly THEN 'Week' ELSE 'Month' END AS detail_time_period_type, d.is_deleted AS detail_is_deleted,
           summary.ts AS summary_created_date
    FROM calc JOIN (SELECT *, row_number() OVER (ORDER BY resource_id) AS row FROM detail) AS d ON d.calc_id = calc.id
    JOIN summary ON summary.calc_id = calc.id JOIN person ON person.resource_id = d.resource_id
    ORDER BY calc.id, d.resource_id, {_DETAIL_ORDER}, row, person.name, summary.ts
    LIMIT 2000""",
)

# --------------------------------------------------------------- G. profiling

_LINEITEM = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
    "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "", "l_linestatus": "",
    "l_shipdate": "d",
}


def _facts(column: str, kind: str) -> str:
    zeros = f"count(*) FILTER (WHERE {column} = 0)" if kind == "n" else "NULL::BIGINT"
    newest = f"max({column})::DATE" if kind == "d" else "NULL::DATE"
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS \"rows\", count(*) - count({column}) AS nulls,"
        f" {zeros} AS zeros, count(DISTINCT {column}) AS distinct_values, {newest} AS max_date,"
        f" ({AS_OF} - {newest})::INTEGER AS days_since_max FROM lineitem"
    )


PROFILING = {
    "table_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "table_profile": "\nUNION ALL\n".join(_facts(c, kind) for c, kind in _LINEITEM.items()),
}

#: Columns with their types; a number's zeros and a time's newest date are facts.
_TABLES = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double"
    " o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double"
    " l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string"
    " l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
}


def _column_facts(table: str, column: str, kind: str, times: list[str]) -> str:
    number = kind in ("int", "bigint", "double")
    zeros = f"bool_and({column} = 0)" if number else "NULL::BOOLEAN"
    newest = f"max({column})::DATE" if column in times else "NULL::DATE"
    of_table = f"greatest({', '.join(f'max({c})::DATE' for c in times)})" if times else "NULL::DATE"
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{kind}' AS type, count(*) AS \"rows\","
        f" count(*) - count({column}) AS nulls, {zeros} AS zeros_only, {newest} AS newest,"
        f" ({AS_OF} - {newest})::INTEGER AS days_since, CASE WHEN count(*) = 0 THEN 'empty'"
        f" WHEN count({column}) = 0 THEN 'all null' WHEN {zeros} THEN 'zeros only'"
        f" WHEN {AS_OF} - {of_table} > 365 THEN 'stale' ELSE 'data' END AS verdict FROM {table}"
    )


def _catalog() -> str:
    parts = []
    for table, columns in _TABLES.items():
        kinds = dict(c.split(":") for c in columns.split())
        times = [c for c, kind in kinds.items() if kind == "timestamp_ntz"]
        parts += [_column_facts(table, c, kind, times) for c, kind in kinds.items()]
    return "\nUNION ALL\n".join(parts)


PROFILING["catalog_profile"] = _catalog()

ORACLES: dict[str, str] = (
    FUNNEL | HISTORY | WBS | DASHBOARD | STAFFING | UTILIZATION | PROFILING
)
