"""Request streams over files decide as one batch in the same order."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.plans.bookings import apply_bookings
from campusflow.plans.orders import apply_orders
from campusflow.sources.fixtures import AS_OF, FixtureTables
from campusflow.streaming.order_stream import read_decisions, start_booking_stream, start_order_stream
from tests.conftest import SMALL


def _three_files(requests: DataFrame, folder: str) -> str:
    """Write the requests as three parquet files cut by time (file order = batch order)."""
    cuts = requests.select(F.percentile_approx("request_ts", [0.33, 0.66]).alias("q")).first()["q"]
    parts = [
        requests.where(F.col("request_ts") < cuts[0]),
        requests.where((F.col("request_ts") >= cuts[0]) & (F.col("request_ts") < cuts[1])),
        requests.where(F.col("request_ts") >= cuts[1]),
    ]
    stream_dir = os.path.join(folder, "stream_in")
    os.makedirs(stream_dir)
    for i, p in enumerate(parts):
        written = os.path.join(folder, f"part{i}")
        p.coalesce(1).write.parquet(written)
        name = next(f for f in os.listdir(written) if f.endswith(".parquet"))
        os.link(os.path.join(written, name), os.path.join(stream_dir, f"{i:03d}.parquet"))
    return stream_dir


def _decided(rows) -> set:
    return {(r["request_id"], r["accepted"], r["reason"]) for r in rows}


@pytest.mark.parametrize("compact", [50, 1])
def test_order_stream_equals_one_batch(spark, scratch, monkeypatch, compact):
    from campusflow.streaming import order_stream

    monkeypatch.setattr(order_stream, "COMPACT", compact)
    t = FixtureTables(spark, SMALL)

    def initial():
        return {"tickets": t.tickets, "participants": t.participants, "students": t.students, "events": t.events,
                "venues": t.venues, "hosts": t.hosts}

    stream_dir = _three_files(t.order_requests, scratch)
    state = os.path.join(scratch, "state")
    q = start_order_stream(spark, stream_dir, state, os.path.join(scratch, "ckpt"), initial, AS_OF)
    q.awaitTermination(600)
    decisions = read_decisions(spark, state)
    assert decisions.select("v").distinct().count() == 3
    batch = apply_orders(t.tickets, t.participants, t.students, t.events, t.venues, t.hosts, t.order_requests, AS_OF)
    assert _decided(decisions.collect()) == _decided(batch["decisions"].collect())


def test_booking_stream_equals_one_batch(spark, scratch):
    t = FixtureTables(spark, SMALL)

    def initial():
        return {"events": t.events, "venues": t.venues, "hosts": t.hosts, "resources": t.resources,
                "bookings": t.bookings, "maintenance": t.maintenance}

    stream_dir = _three_files(t.booking_requests, scratch)
    state = os.path.join(scratch, "state")
    q = start_booking_stream(spark, stream_dir, state, os.path.join(scratch, "ckpt"), initial, AS_OF)
    q.awaitTermination(600)
    batch = apply_bookings(t.events, t.venues, t.hosts, t.resources, t.bookings, t.maintenance, t.booking_requests,
                           AS_OF)
    assert _decided(read_decisions(spark, state).collect()) == _decided(batch["decisions"].collect())


def test_cancel_stream_equals_one_batch(spark, scratch):
    from campusflow.plans.orders import apply_cancellations
    from campusflow.streaming.order_stream import start_cancel_stream

    t = FixtureTables(spark, SMALL)

    def initial():
        return {"participants": t.participants, "events": t.events, "tickets": t.tickets, "orders": t.orders}

    stream_dir = _three_files(t.cancel_requests, scratch)
    state = os.path.join(scratch, "state")
    q = start_cancel_stream(spark, stream_dir, state, os.path.join(scratch, "ckpt"), initial, AS_OF)
    q.awaitTermination(600)
    batch = apply_cancellations(t.participants, t.events, t.tickets, t.orders, t.cancel_requests, AS_OF)
    assert _decided(read_decisions(spark, state).collect()) == _decided(batch["decisions"].collect())
    last = spark.read.parquet(os.path.join(state, "participants", "v=2"))
    assert last.count() == batch["participants_after"].count()
