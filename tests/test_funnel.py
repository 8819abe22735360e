import datetime as dt

from dealtide.operators import dashboard, funnel
from tests.frames import change, day, deal, frame


def opps(spark, *deals):
    return frame(spark, "opportunity", list(deals))


def lost(id, created, close, **columns):
    return deal(id, created, close, is_won=False, stage_name="Closed Lost", **columns)


def test_win_rate_counts_won_duplicates_only_in_the_numerator(spark):
    df = opps(
        spark,
        deal("a", "2021-01-05", "2021-02-01"),
        deal("b", "2021-01-05", "2021-02-01", stage_name="Closed Duplicate"),
        lost("c", "2021-03-05", "2021-04-01"),
        lost("d", "2021-03-05", "2021-04-01"),
        lost("e", "2022-03-05", "2022-04-01"),
        deal("f", "2019-12-31T23:59:59", "2020-04-01"),
        deal("g", "2023-01-01", "2023-04-01", is_closed=False),
    )
    rows = [tuple(r) for r in funnel.win_rate_by_year(df).collect()]
    # 2 won of 3 closed; a year without a win is NULL, not 0; an open year is absent.
    assert rows == [(2021, 66.7), (2022, None)]


def test_win_rate_keeps_year_of_duplicate_win_out_of_the_denominator(spark):
    df = opps(spark, deal("b", "2021-01-05", "2021-02-01", stage_name="Closed - Duplicate"))
    assert funnel.win_rate_by_year(df).collect() == []


def test_practice_filter_has_no_year_floor(spark):
    df = opps(
        spark,
        deal("a", "1999-01-05", "1999-02-01", practice="DATA (L2)"),
        deal("b", "1999-01-05", "1999-02-01", practice="Data Protection"),
        deal("c", "1999-01-05", "1999-02-01", practice=None),
        deal("d", "1999-01-05", "1999-02-01", created_date=None),
    )
    assert [tuple(r) for r in funnel.win_rate_by_year_for_practice(df).collect()] == [
        (1999, 100.0),
        (None, None),  # an unknown year matches no year of wins
    ]


def test_not_in_rules_for_unknown_creators(spark):
    def blank(creator, created):
        return deal(creator or "x", created, "2021-09-01", practice=None, created_by_id=creator)

    single = [blank("a", "2021-01-01"), blank(None, "2021-01-02")]
    bulk = [blank("b", f"2021-05-05T0{i}:00:00") for i in range(3)]
    unknown_bulk = [blank(None, f"2021-06-06T0{i}:00:00") for i in range(3)]

    def counts(rows):
        return tuple(funnel.null_practice_excluding_bulk_creators(opps(spark, *rows)).first())

    assert counts(single) == (2, 0)  # an empty list excludes nobody
    assert counts(single + bulk) == (1, 1)  # an unknown creator is not "not in" a list
    assert counts(single + bulk + unknown_bulk) == (0, 1)  # a NULL in the list excludes all
    assert counts([blank("b", "2019-05-05")]) == (0, 0)


def test_share_of_creators_uses_the_whole_year(spark):
    rows = [
        deal(f"{who}{i}", "2021-02-03", "2021-09-01", practice=None, created_by_id=who)
        for who, n in (("a", 12), ("b", 10), ("c", 2))
        for i in range(n)
    ]
    out = funnel.null_practice_share_by_creator(opps(spark, *rows)).collect()
    assert [tuple(r) for r in out] == [("a", 2021, 12, 24, 50.0), ("b", 2021, 10, 24, 41.7)]


def test_single_deal_has_no_deviation_and_is_dropped(spark):
    df = opps(spark, deal("a", "2021-01-01", "2021-03-01"))
    assert tuple(funnel.days_to_close_stats(df).first()) == (None, None)


def test_equal_days_are_all_kept(spark):
    df = opps(spark, *[deal(str(i), "2021-01-01", "2021-01-11") for i in range(5)])
    assert tuple(funnel.days_to_close_stats(df).first()) == (10.0, 10.0)


def test_outliers_and_quick_wins_are_left_out(spark):
    usual = [deal(f"u{i}", "2021-01-01", f"2021-01-{11 + i % 2}") for i in range(20)]
    quick = [deal("q0", "2021-01-01", "2021-01-01"), deal("q1", "2021-01-01T23:00:00", "2021-01-02")]
    early = [deal("q2", "2021-01-05", "2021-01-04")]
    far = [deal("far", "2021-01-01", "2024-01-01")]
    df = opps(spark, *usual, *quick, *early, *far)
    assert tuple(funnel.days_to_close_stats(df).first()) == (10.5, 10.5)
    assert [tuple(r) for r in funnel.quick_wins_by_year(df).collect()] == [(2021, 2)]


def test_latest_stage_of_a_day_counts(spark):
    df = opps(
        spark,
        deal("a", "2021-01-01", "2021-01-31"),
        deal("b", "2021-01-01", "2021-01-31"),
        lost("c", "2021-01-01", "2021-01-31"),
    )
    history = frame(
        spark,
        "opportunity_field_history",
        [
            change("a", "2021-01-10T08:00:00", "StageName", "x", "Prospecting / Lead"),
            change("a", "2021-01-10T08:00:00.000001", "StageName", "x", "Pipeline"),
            change("a", "2021-01-11T00:00:00", "stagename", "x", "Upside"),
            change("a", "2021-01-11T00:00:00", "stagename", "x", "Strong Upside"),
            change("b", "2021-01-21T00:00:00", "STAGENAME", "x", "Committed"),
            change("b", "2021-01-22T00:00:00", "StageName", "x", "Closed"),
            change("b", "2021-01-23T00:00:00", "CloseDate", "x", "Commit"),
            change("c", "2021-01-23T00:00:00", "StageName", "x", "Commit"),
        ],
    )
    row = funnel.stage_days_to_close_by_year(df, history).first().asDict()
    # At the same moment the stage further down the list counts.
    assert row == {
        "year_opp_created": 2021,
        "prospecting_lead_avg_days_till_close": None,
        "pipeline_avg_days_till_close": 21.0,
        "upside_avg_days_till_close": None,
        "strong_upside_avg_days_till_close": 20.0,
        "committed_avg_days_till_close": 10.0,
    }


def test_mean_of_negative_days_rounds_away_from_zero(spark):
    deals = [deal(x, "2021-01-01", "2021-01-31") for x in "abcd"]
    changes = [
        change(x, f"2021-02-0{n}", "StageName", "x", "Pipeline") for x, n in zip("abcd", (1, 1, 1, 2))
    ]
    history = frame(spark, "opportunity_field_history", changes)
    row = funnel.stage_days_to_close_by_year(opps(spark, *deals), history).first()
    assert row.pipeline_avg_days_till_close == -1.3  # -1.25


def test_loss_reason_rate_is_null_without_any_reason(spark):
    df = opps(
        spark,
        lost("a", "2021-01-01", "2021-02-01"),
        lost("b", "2022-01-01", "2022-02-01", reason_code="Price"),
        lost("c", "2022-01-01", "2022-02-01"),
        lost("d", "2022-01-01", "2022-02-01"),
    )
    assert [tuple(r) for r in funnel.loss_reason_rate(df).collect()] == [(2021, None), (2022, 33.3)]


def test_unknown_practice_is_a_group(spark):
    df = opps(
        spark,
        deal("a", "2021-01-01", "2021-02-01", practice=None),
        deal("b", "2021-01-01", "2021-02-01", practice=None),
        deal("c", "2021-01-01", "2021-02-01"),
    )
    assert [tuple(r) for r in funnel.opps_by_practice(df).collect()] == [(None, 2), ("Data", 1)]


def test_windows_move_by_calendar_boundary(spark):
    df = opps(
        spark,
        deal("a", "2020-01-01", "2020-06-30"),  # four quarters back
        deal("b", "2020-01-01", "2020-07-01"),  # three quarters back
        deal("c", "2021-01-01", "2021-03-31"),
        deal("d", "2021-01-01", "2021-04-01"),
        deal("e", "2021-01-01", "2021-04-02"),  # after the report date
        deal("f", "2019-01-01", "2019-01-01"),  # two years back
        deal("g", "2018-12-01", "2018-12-31"),  # three years back
    )
    as_of = dt.date(2021, 4, 1)
    won = dashboard.win_rate_by_practice_quarter(df, as_of=as_of).collect()
    assert [(r.year_opp_closed, r.quarter_opp_closed, r.won_opps) for r in won] == [
        (2019, 1, 1),
        (2020, 2, 1),
        (2020, 3, 1),
        (2021, 1, 1),
        (2021, 2, 1),
    ]
    history = frame(
        spark,
        "opportunity_field_history",
        [change(x, "2021-01-10", "StageName", "x", "Pipeline") for x in "abcde"],
    )
    quarters = dashboard.stage_days_by_practice_quarter(df, history, as_of=as_of).collect()
    assert [(r.year_opp_closed, r.quarter_opp_closed) for r in quarters] == [
        (2020, 3),
        (2021, 1),
        (2021, 2),
    ]


def test_group_without_a_win_loses_its_quarter(spark):
    df = opps(
        spark,
        lost("a", "2021-01-01", "2021-02-01", practice="Network"),
        deal("b", "2021-01-01", "2021-02-01", practice="MS - Security"),
        lost("c", "2021-01-01", "2021-02-01", practice=None),
        deal("d", "2021-01-01", "2021-02-01", practice=None),
    )
    as_of = dt.date(2021, 4, 1)
    wins = dashboard.win_rate_by_practice_quarter(df, as_of=as_of)
    assert [tuple(r) for r in wins.collect()] == [
        ("Managed Services", 2021, 1, 1, 1, 0, 100.0),
        ("Network", None, None, None, 1, None, None),
        ("Null", 2021, 1, 1, 2, 1, 50.0),
    ]
    wbs = frame(
        spark,
        "wbs",
        [
            {"opportunity_id": x, "created_date": dt.datetime(2021, 1, 1), "role": "r", "hours": 8}
            for x in "bd"
        ],
    )
    hours = dashboard.wbs_hours_by_practice_quarter(df, wbs, as_of=as_of)
    both = dashboard.wbs_hours_and_win_rate(hours, wins).collect()
    assert [tuple(r) for r in both] == [
        ("Managed Services", 2021, 1, None, None, 1, 1, 0, 100.0),
        ("Null", 2021, 1, 8.0, 1, 1, 2, 1, 50.0),
    ]


def test_table_of_practice_labels(spark):
    names = {
        "Public CLOUD data": "Cloud",
        "data protection": "Data Protection",
        "Data (L2)": "Data",
        "Application Svc": "AppDev",
        "EUC": "EUC",
        "Systems": "Managed Services",
        "modern": "Modern Infrastructure",
        "Other": "Null",
        None: "Null",
    }
    deals = [
        deal(str(i), "2021-01-01", "2021-02-01", practice=name) for i, name in enumerate(names)
    ]
    from dealtide.functions.labels import with_deal_practice

    got = with_deal_practice(opps(spark, *deals).orderBy("id")).collect()
    assert [r.practice for r in got] == list(names.values())
    assert day("2021-02-01") == got[0].close_date
