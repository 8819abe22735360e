import datetime as dt

from dealtide.operators import history as changes
from dealtide.operators import wbs as hours
from tests.frames import at, change, deal, frame


def tables(spark, deals, rows):
    return frame(spark, "opportunity", deals), frame(spark, "opportunity_field_history", rows)


def test_changes_per_deal_count_days_and_unchanged_deals(spark):
    opps, history = tables(
        spark,
        [
            deal("a", "2021-01-01", "2021-06-01"),
            deal("b", "2021-01-01", "2021-06-01"),
            deal("c", "2022-01-01", "2022-06-01"),
            deal("d", "2021-01-01", "2021-06-01", is_won=False),
        ],
        [
            change("a", "2021-02-01T01:00:00", "CloseDate", "x", "y"),
            change("a", "2021-02-01T23:00:00", "CloseDate", "x", "y"),
            change("a", "2021-02-02T00:00:00", "closedate", "x", "y"),
            change("a", "2021-02-03T00:00:00", "CloseDate", "x", "y"),
            change("d", "2021-02-01T00:00:00", "CloseDate", "x", "y"),
            change("c", "2022-02-01T00:00:00", "StageName", "x", "y"),
        ],
    )
    # 3 days over 2 won deals; 2022 never changed and is absent.
    assert [tuple(r) for r in changes.closedate_changes_per_opp(opps, history).collect()] == [
        (2021, 1.5)
    ]
    named = changes.stage_changes_per_opp_for_practice(opps, history)
    assert named.columns == ["year_opp_created", "avg_stagename_changes_per_data_opp"]
    assert [tuple(r) for r in named.collect()] == [(2022, 1.0)]


def test_movement_buckets_at_their_ends(spark):
    start = dt.date(2021, 3, 1)
    days = [0, 1, 7, 8, 30, 31, -5]
    rows = []
    for i, n in enumerate(days):
        old = start + dt.timedelta(days=i + n)  # lead n on day start + i
        rows.append(
            change(
                "a",
                f"{start + dt.timedelta(days=i)}T09:00:00",
                "CloseDate",
                str(old),
                str(old + dt.timedelta(days=n)),
            )
        )
    rows += [
        change("a", "2021-05-01T09:00:00", "CloseDate", "not a date", "2021-05-01"),
        change("a", "2021-05-02T09:00:00", "CloseDate", "2021-06-02", None),
        # the same day: only the first counts
        change("a", "2021-05-02T10:00:00", "CloseDate", "2021-05-02", "2021-05-02"),
        change("b", "2021-05-02T10:00:00", "StageName", "x", "y"),
    ]
    opps, history = tables(
        spark,
        [
            deal("a", "2021-01-01", "2021-06-01"),
            deal("b", "2021-01-01", "2021-06-01"),
            deal("without history", "2021-01-01", "2021-06-01"),
            # moved, but no unmoved deal in its year
            deal("c", "2022-01-01", "2022-06-01"),
        ],
        rows + [change("c", "2022-05-02T10:00:00", "CloseDate", "2022-05-02", "2022-05-02")],
    )
    out = changes.closedate_movement(opps, history).collect()
    assert len(out) == 1
    row = out[0]
    assert (row.num_unique_opps, row.num_opps_w_unchanged_closedate) == (2, 1)
    assert tuple(row)[3:7] == (2, 2, 2, 2)  # lead: 0 and -5; 1, 7; 8, 30; 31 and 31
    assert tuple(row)[7:11] == (2, 2, 2, 1)  # shift: 0 and -5; 1, 7; 8, 30; 31
    # per measure, the buckets hold every change day with a known value
    assert sum(tuple(row)[3:7]) == 8 and sum(tuple(row)[7:11]) == 7


def entry(deal_id, when, role, n):
    return {"opportunity_id": deal_id, "created_date": at(when), "role": role, "hours": n}


def test_newest_batch_is_found_before_roles_are_filtered(spark):
    opps = frame(
        spark,
        "opportunity",
        [
            deal("a", "2021-01-01", "2021-06-01"),
            deal("b", "2021-01-01", "2021-06-01"),
            deal("c", "2021-01-01", "2021-06-01", practice="Network"),
        ],
    )
    wbs = frame(
        spark,
        "wbs",
        [
            entry("a", "2021-01-01T00:00:00", "Data Engineer", 100),
            entry("a", "2021-02-01T00:00:00", "Data Engineer", 8),
            entry("a", "2021-02-01T00:00:00", "Data Architect", 4.25),
            entry("a", "2021-02-01T00:00:00", "Cloud Engineer", 40),
            entry("a", "2021-03-01T00:00:00", "Data Engineer", 0),  # no hours: not a batch
            entry("b", "2021-01-01T00:00:00", "Data Engineer", 10),
            entry("b", "2021-02-01T00:00:00", "Data Contractor", 20),
            entry("c", "2021-02-01T00:00:00", "Data Engineer", 7),
        ],
    )
    assert [tuple(r) for r in hours.wbs_hours_by_practice(opps, wbs).collect()] == [
        (2021, "Data", 18.1, 2),  # (8 + 4.25 + 40 + 20) / 4
        (2021, "Network", 7.0, 1),
    ]
    assert [tuple(r) for r in hours.wbs_hours_for_practice(opps, wbs).collect()] == [
        (2021, 6.1, 1)  # (8 + 4.25) / 2; b has no data role in its newest batch
    ]
    assert [tuple(r) for r in hours.wbs_hours_by_role(opps, wbs).collect()] == [
        (2021, "Data Engineer", 8.0),
        (2021, "Data Architect", 4.3),
    ]
