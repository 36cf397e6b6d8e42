"""Resource bookings for events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import first_reason, unparseable
from campusflow.operators.conflicts import booked_in_slot, maintenance_hits, with_span
from campusflow.operators.reports import upcoming_events
from campusflow.plans.admission import admit_overlapping
from campusflow.plans.common import EMPTY_LIST, checkpoint, decide, order_key


def booking_check(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, resources: DataFrame, bookings: DataFrame,
    maintenance: DataFrame, requests: DataFrame, as_of: datetime | None = None,
) -> DataFrame:
    """Each booking request checked against the stored state alone.

    Checks: EMPTY_LIST (no upcoming event, or no resources) →
    INVALID_RESOURCE → OVER_TOTAL (more than the resource has) →
    NON_POSITIVE → UNPARSEABLE → BAD_TIME → MAINTENANCE (a maintenance
    window of the resource overlaps) → INSUFFICIENT (more than the total
    minus what stored bookings overlapping the slot hold). The resource's
    flag and status and the event's own times are not consulted.
    """
    r = with_span(requests).withColumn("_ord", order_key())
    res = resources.select(F.col("id").alias("resource_id"), F.col("quantity").alias("total"))
    ev_ids = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_event"))
    booked = booked_in_slot(r, bookings).select("request_id", "booked")
    maint = maintenance_hits(r, maintenance).select("request_id", "maintenance_hits")
    r = (
        r.join(res, "resource_id", "left").join(ev_ids, "event_id", "left")
        .join(booked, "request_id", "left").join(maint, "request_id", "left")
    )
    reason = first_reason([
        (~upcoming_events(events, venues, hosts, as_of).exists(), EMPTY_LIST),
        (~resources.exists(), EMPTY_LIST),
        (F.col("total").isNull(), "INVALID_RESOURCE"),
        (F.col("quantity").isNull() | (F.col("quantity") > F.col("total")), "OVER_TOTAL"),
        (F.col("quantity") <= 0, "NON_POSITIVE"),
        (unparseable("start_text") | unparseable("end_text") | F.col("start_ts").isNull() | F.col("end_ts").isNull(),
         "UNPARSEABLE"),
        (F.col("end_ts") <= F.col("start_ts"), "BAD_TIME"),
        (F.col("maintenance_hits") > 0, "MAINTENANCE"),
        (F.col("quantity") > F.col("total") - F.col("booked"), "INSUFFICIENT"),
    ])
    return r.withColumn("reason", reason)


def apply_bookings(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, resources: DataFrame, bookings: DataFrame,
    maintenance: DataFrame, requests: DataFrame, as_of: datetime | None = None, max_rounds: int | None = None,
) -> dict[str, DataFrame]:
    """Book resources in batch order.

    The checks of ``booking_check``, where INSUFFICIENT also counts bookings
    accepted earlier in the batch whose slot overlaps, then UNKNOWN_EVENT
    (the insert's reference). The batch is decided by ``admit_overlapping``
    (bookings of one resource with overlapping slots compete), busy period by
    busy period.
    """
    # Read twice below: materialize once.
    r = checkpoint(booking_check(events, venues, hosts, resources, bookings, maintenance, requests, as_of))
    # Requests of unknown events pass every check but the event's: they are
    # refused as INSUFFICIENT first, and take nothing.
    live = r.where(F.col("reason").isNull()).select(
        "request_id", "_ord", "resource_id", "start_ts", "end_ts", F.col("quantity").alias("need"),
        (F.col("total") - F.col("booked")).alias("cap"), F.col("_event").isNotNull().alias("takes"),
    )
    status = admit_overlapping(live, ["resource_id"], max_rounds).withColumnRenamed("accepted", "_fits")
    r = r.join(status, "request_id", "left")
    reason = F.coalesce(
        F.col("reason"), first_reason([(~F.col("_fits"), "INSUFFICIENT"), (F.col("_event").isNull(), "UNKNOWN_EVENT")])
    )
    d = decide(r, reason, "request_id", "event_id", "resource_id", "quantity", "start_ts", "end_ts")
    delta = d.where("accepted").select(
        "request_id", "event_id", "resource_id", F.col("quantity").alias("quantity_booked"),
        F.col("start_ts").alias("booking_start"), F.col("end_ts").alias("booking_end"),
    )
    return {"decisions": d.select("request_id", "resource_id", "quantity", "accepted", "reason"),
            "bookings_delta": delta}
