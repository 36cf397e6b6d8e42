"""The batch job reads stored tables, runs a flow or report, and writes every output."""

from __future__ import annotations

import os

import pytest

from campusflow.jobs import FLOWS, RejectedState, committed, run_flow, run_report
from campusflow.plans.orders import apply_orders
from campusflow.sources.fixtures import AS_OF, FixtureTables
from campusflow.sources.tables import CORRUPT, read_table
from tests.conftest import SMALL


def test_orders_job_over_stored_tables(spark, scratch):
    t = FixtureTables(spark, SMALL)
    tables = os.path.join(scratch, "state")
    for name, df in t.as_dict().items():
        df.write.parquet(os.path.join(tables, name))
    requests = os.path.join(scratch, "order_requests")
    t.order_requests.write.parquet(requests)
    out = os.path.join(scratch, "run1")
    written = run_flow(spark, tables, "orders", requests, out, AS_OF)
    assert written == ["decisions", "orders_delta", "participants_delta", "rejects", "state_rejects", "tickets_after"]
    got = {(r["request_id"], r["accepted"], r["reason"]) for r in spark.read.parquet(os.path.join(out, "decisions")).collect()}
    direct = apply_orders(t.tickets, t.participants, t.students, t.events, t.venues, t.hosts, t.order_requests, AS_OF)
    assert got == {(r["request_id"], r["accepted"], r["reason"]) for r in direct["decisions"].collect()}
    # the new ticket state is a readable state table again
    assert read_table(spark, "tickets", os.path.join(out, "tickets_after")).count() == t.tickets.count()

    run_report(spark, tables, "upcoming_events", out, AS_OF)
    assert spark.read.parquet(os.path.join(out, "upcoming_events")).count() == 704


def _counts_add_up(spark, out):
    counts = committed(spark, out)
    assert counts["read"] == counts["rejected"] + counts["accepted"] + counts["refused"]
    return counts


@pytest.mark.parametrize("flow", ["event_updates", "bookings", "new_hosts", "feedback", "tickets"])
def test_every_run_counts_its_requests(spark, scratch, flow):
    t = FixtureTables(spark, SMALL)
    tables = os.path.join(scratch, "state")
    for name, df in t.as_dict().items():
        df.write.parquet(os.path.join(tables, name))
    kind = FLOWS[flow][0]
    requests = os.path.join(scratch, kind)
    rows = getattr(t, kind).limit(40)
    rows.write.parquet(requests)
    out = os.path.join(scratch, "run")
    assert run_flow(spark, tables, flow, requests, out, AS_OF)
    counts = _counts_add_up(spark, out)
    assert counts["read"] == 40 and counts["rejected"] == 0
    # A finished run is not run again.
    assert run_flow(spark, tables, flow, requests, out, AS_OF) == []


def test_rejects_of_state_tables_are_written_or_refuse_the_run(spark, scratch):
    tables, requests, out = (os.path.join(scratch, n) for n in ("state", "requests", "run"))
    for name, df in FixtureTables(spark, SMALL).as_dict().items():
        df.limit(50).write.option("header", True).csv(os.path.join(tables, name))
    with open(os.path.join(tables, "venues", "more.csv"), "w") as f:
        f.write("id,name,building,capacity,is_available\n9001,Big,B,many,1\n9002,x,y,1,1,1,1\n")
    os.makedirs(requests)
    with open(os.path.join(requests, "r.json"), "w") as f:
        f.write('{"request_id": 1, "request_ts": "2024-01-01 10:00:00", "venue_id": 3, "new_status": 1}\n{"request_id": 2,\n')
        f.write('{"request_id": 3, "request_ts": "2024-01-01 10:00:00", "venue_id": "three", "new_status": 0}\n')
    given = {"fmt": "json", "tables_fmt": "csv", "tables_options": {"header": "true"}}
    with pytest.raises(RejectedState, match="venues: 2"):
        run_flow(spark, tables, "venue_flags", requests, out, AS_OF, strict=True, **given)
    assert committed(spark, out) is None
    run_flow(spark, tables, "venue_flags", requests, out, AS_OF, **given)
    state = spark.read.parquet(os.path.join(out, "state_rejects")).collect()
    assert {(r["table"], r["key"], r["column"]) for r in state} == {("venues", "9001", "capacity"), ("venues", "9002", CORRUPT)}
    counts = _counts_add_up(spark, out)
    assert (counts["read"], counts["rejected"]) == (3, 2)
    run_report(spark, tables, "available_venues", os.path.join(scratch, "report"), AS_OF, tables_fmt="csv", tables_options={"header": "true"})
    assert spark.read.parquet(os.path.join(scratch, "report", "available_venues_rejects")).count() == 2
