"""Order-dependent flows against a one-request-at-a-time replay in plain Python."""

from __future__ import annotations

import __spark_entry__ as entry
from tests import sequential as seq
from tests.conftest import SMALL


def _decisions(spark, name):
    return {r["request_id"]: (r["accepted"], r["reason"]) for r in entry.queries()[name](spark, SMALL).collect()}


def test_orders_match_replay(spark, duck_small):
    assert _decisions(spark, "order_decisions") == seq.simulate_orders(duck_small)


def test_new_events_match_replay(spark, duck_small):
    assert _decisions(spark, "event_admission") == seq.simulate_new_events(duck_small)


def test_bookings_match_replay(spark, duck_small):
    assert _decisions(spark, "booking_decisions") == seq.simulate_bookings(duck_small)


def test_hosts_match_replay(spark, duck_small):
    got = {r["request_id"]: r["accepted"] for r in entry.queries()["host_decisions"](spark, SMALL).collect()}
    assert got == seq.simulate_hosts(duck_small)


def test_order_effects_are_consistent(spark):
    from campusflow.plans.orders import apply_orders
    from campusflow.sources.fixtures import AS_OF, FixtureTables

    t = FixtureTables(spark, SMALL)
    out = apply_orders(t.tickets, t.participants, t.students, t.events, t.venues, t.hosts, t.order_requests, AS_OF)
    d = out["decisions"].toPandas()
    after = out["tickets_after"].toPandas().set_index("id")["quantity"]
    before = t.tickets.toPandas().set_index("id")["quantity"]
    assert (after >= 0).all()
    taken = d[d.accepted].groupby("ticket_id")["how_many"].sum()
    for tid, n in taken.items():
        assert before[tid] - after[tid] == n
    assert out["orders_delta"].count() == int(d[d.accepted]["how_many"].sum())
    assert len(d) == d["request_id"].nunique() == t.order_requests.count()
