"""Invariants of the request flows on the sf0.001 stand-in data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from campusflow.queries import fixtures
from tests.conftest import SMALL

DECISIONS = {
    "order_decisions": "order_requests",
    "cancel_decisions": "cancel_requests",
    "event_admission": "event_requests",
    "event_update_decisions": "event_update_requests",
    "booking_decisions": "booking_requests",
    "booking_check": "booking_requests",
    "maintenance_decisions": "maintenance_requests",
    "attendance_decisions": "attendance_requests",
    "venue_flag_decisions": "venue_flag_requests",
    "resource_flag": "resource_status_requests",
    "feedback_eligibility": "feedback_requests",
    "unique_students": "student_requests",
    "host_decisions": "host_requests",
}


@pytest.mark.parametrize("name", sorted(DECISIONS))
def test_one_decision_per_request(spark, name):
    d = entry.queries()[name](spark, SMALL)
    requests = getattr(fixtures(spark, SMALL), DECISIONS[name])
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("request_id").alias("ids")).first()
    assert stats["n"] == stats["ids"] == requests.count()
    if "accepted" in d.columns:
        # accepted exactly when no reason is given
        assert d.where(F.col("accepted") != F.col("reason").isNull()).count() == 0


def test_accepted_events_never_overlap(spark):
    from campusflow.operators.conflicts import venue_conflicts

    t = fixtures(spark, SMALL)
    new = entry.queries()["events_delta"](spark, SMALL)
    combined = t.events.select("id", "location_id", "start_ts", "end_ts").unionByName(
        new.select(F.col("request_id").alias("id"), "location_id", "start_ts", "end_ts")
    )
    new_ids = new.select(F.col("request_id").alias("event_id_a"))
    pairs = venue_conflicts(combined)
    touching_new = pairs.join(new_ids, "event_id_a", "left_semi").unionByName(
        pairs.join(new_ids.withColumnRenamed("event_id_a", "event_id_b"), "event_id_b", "left_semi")
    )
    assert touching_new.count() == 0


def test_stock_is_conserved(spark):
    t = fixtures(spark, SMALL)
    after = entry.queries()["ticket_stock_after"](spark, SMALL)
    delta = entry.queries()["orders_delta"](spark, SMALL)
    assert after.where(F.col("quantity") < 0).count() == 0
    before_total = t.tickets_unset.agg(F.sum("quantity")).first()[0]
    after_total = after.agg(F.sum("quantity")).first()[0]
    assert before_total - after_total == delta.count()
