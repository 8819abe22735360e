import datetime as dt

import pytest

from dealtide.operators import staffing
from tests.frames import at, deal, frame

AS_OF = dt.date(2022, 1, 1)


def event(request, when, field, old=None, new=None):
    return {
        "parent_id": request,
        "created_date": at(when),
        "field": field,
        "old_value": old,
        "new_value": new,
    }


def person(request, when, name="Jane Doe"):
    return event(request, when, "pse__Staffer_Resource__c", "a0X1", name)


def released(request, when, old="true"):
    return event(request, when, "pse__Resource_Held__c", old, "false")


def other(request, when):
    return event(request, when, "pse__Status__c", "x", "y")


# Requested on 1 March 2021. Name: events, days held at the end.
CASES = {
    "no history": ([], None),
    "never changed, never released, 10 days": ([other("", "2021-03-11T00:00:00")], 10),
    "never changed, never released, 9 days": ([other("", "2021-03-10T23:59:59")], 9),
    "never changed, first release counts": (
        [released("", "2021-03-04T00:00:00"), released("", "2021-04-20T00:00:00")],
        3,
    ),
    "changed, last release counts": (
        [
            person("", "2021-03-05T22:00:00"),
            released("", "2021-03-06T00:00:00"),
            released("", "2021-03-15T01:00:00"),
        ],
        10,
    ),
    "released before the change, not replaced by the end": (
        [
            released("", "2021-03-05T00:00:00"),
            person("", "2021-03-10T00:00:00"),
            other("", "2021-06-01T00:00:00"),
        ],
        -5,
    ),
    "changed, never released": (
        [person("", "2021-03-05T00:00:00"), other("", "2021-03-15T00:00:00")],
        10,
    ),
    "an id is not a person": (
        [person("", "2021-04-01T00:00:00", "a0X1"), other("", "2021-04-02T00:00:00")],
        32,
    ),
    "flag text that is no boolean": (
        [released("", "2021-03-02T00:00:00", "maybe"), other("", "2021-04-02T00:00:00")],
        32,
    ),
    "flag that was not set": (
        [released("", "2021-03-02T00:00:00", "false"), other("", "2021-04-02T00:00:00")],
        32,
    ),
}


@pytest.fixture(scope="module")
def tables(spark):
    names = list(CASES)
    requests = [
        {
            "id": name,
            "opportunity_id": f"deal {i % 3}",
            "resource_id": "r1",
            "practice": "Data" if i % 2 else "Data (L2)",
            "role": f"role {i % 2}",
            "created_date": at("2021-03-01T12:00:00"),
        }
        for i, name in enumerate(names)
    ]
    requests.append(requests[1] | {"id": "placeholder", "resource_id": "nobody"})
    deals = [deal(f"deal {i}", "2021-01-01", "2021-09-30", is_won=False) for i in range(3)]
    history = [e | {"parent_id": name} for name, (events, _) in CASES.items() for e in events]
    history.append(other("placeholder", "2021-12-01T00:00:00"))
    actuals = [
        {"resource_id": "r1", "name": "Zoe - x"},
        {"resource_id": "r1", "name": "Ann - y - z"},
    ]
    return (
        frame(spark, "resource_request", requests),
        frame(spark, "opportunity", deals),
        frame(spark, "resource_request_history", history),
        frame(spark, "resource_actuals", actuals),
    )


def held_names():
    return [name for name, (_, days) in CASES.items() if days is not None and days >= 10]


def test_audit_ends_with_the_days_held(tables):
    rows = staffing.resource_request_audit(*tables).collect()
    last = {}
    for row in rows:
        assert row.consultant_name == "Ann"
        if row.final_change_to_resource_request_date is not None:
            days = (row.num_days_held__resource_changed, row.num_days_held__resource_never_changed)
            assert None in days
            last[row.resource_req_id] = days[0] if days[1] is None else days[1]
            assert row.resource_held_and_opp_lost == (last[row.resource_req_id] >= 10)
    assert last == {name: days for name, (_, days) in CASES.items() if days is not None}


def test_audit_numbers_all_events_and_shows_some(tables):
    rows = [
        r
        for r in staffing.resource_request_audit(*tables).collect()
        if r.resource_req_id == "released before the change, not replaced by the end"
    ]
    assert [(r.order_of_events, r.num_days_held__resource_changed) for r in rows] == [
        (1, None),  # the release is known, the change is not
        (2, -5),
        (3, -5),
    ]


def test_held_requests_agree_with_the_audit(tables):
    total = staffing.held_for_lost_by_quarter(*tables, as_of=AS_OF).collect()
    names = held_names()
    deals = {list(CASES).index(n) % 3 for n in names}
    assert [tuple(r) for r in total] == [(2021, "Q3", len(names), len(deals))]
    per_practice = staffing.held_for_lost_by_practice_quarter(*tables, as_of=AS_OF).collect()
    assert sum(r.num_resources_held_and_opp_lost for r in per_practice) == len(names)
    per_role = staffing.held_for_lost_by_role(*tables, as_of=AS_OF).collect()
    odd = [n for n in names if list(CASES).index(n) % 2]
    assert [(r.resource_role, r.num_resources_held_and_opp_lost) for r in per_role] == [
        ("role 1", len(odd))
    ]


def test_deals_closing_after_the_report_date_only_show_in_the_audit(tables):
    early = dt.date(2021, 9, 29)
    assert staffing.held_for_lost_by_quarter(*tables, as_of=early).collect() == []
    assert staffing.resource_request_audit(*tables).count() > 0


def test_real_resources_drops_placeholders_once(tables):
    requests, _, _, actuals = tables
    out = staffing.real_resources(requests, actuals)
    assert out.columns == requests.columns
    assert sorted(r.id for r in out.collect()) == sorted(CASES)


def test_audit_shows_changes_without_a_time_last(spark, tables):
    requests, opps, history, actuals = tables
    name = next(iter(CASES))
    untimed = frame(
        spark,
        "resource_request_history",
        [released(name, "2021-03-02T00:00:00") | {"parent_id": name, "created_date": None}],
    )
    before = staffing.resource_request_audit(*tables).filter(f"resource_req_id = '{name}'")
    after = staffing.resource_request_audit(
        requests, opps, history.unionByName(untimed), actuals, ordered=False
    ).filter(f"resource_req_id = '{name}'")
    assert after.count() == before.count() + 1
    last = after.filter("resource_req_change_date IS NULL").first()
    total = history.filter(f"parent_id = '{name}'").count()
    assert last.order_of_events == total + 1
