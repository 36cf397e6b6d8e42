"""Venue and resource flows: availability flags, status, new resources, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import NEW_RESOURCE_STATUS, UNDER_MAINTENANCE, first_reason, resource_flag, unparseable
from campusflow.operators.conflicts import maintenance_booking_conflicts, with_span
from campusflow.plans.common import checkpoint, decide, EMPTY_LIST, last_value_per_key, nonempty


def apply_venue_flags(venues: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Set venues open (1) or closed (0).

    Checks: INVALID_STATUS (not 0/1) → UNKNOWN_VENUE (no row matched).
    The last valid request per venue decides its flag.
    """
    ids = venues.select(F.col("id").alias("venue_id"), F.lit(True).alias("_known"))
    r = requests.join(ids, "venue_id", "left")
    reason = first_reason([
        (F.col("new_status").isNull() | ~F.col("new_status").isin(0, 1), "INVALID_STATUS"),
        (F.col("_known").isNull(), "UNKNOWN_VENUE"),
    ])
    decisions = decide(r, reason, "request_id", "request_ts", "venue_id", "new_status")
    last = last_value_per_key(decisions, ["venue_id"], "new_status", F.col("accepted"))
    after = venues.join(last.withColumnRenamed("venue_id", "id"), "id", "left").select(
        "id", "name", "building", "capacity",
        F.coalesce(F.col("new_status"), F.col("is_available")).alias("is_available"),
    )
    return {"decisions": decisions.drop("request_ts"), "venues_after": after}


def apply_resource_status(resources: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Set a resource's status text as given; it is available (1) only when the
    text is 'available' in any letter case.

    Checks: EMPTY_LIST (no resources at all) → UNKNOWN_RESOURCE. Last request per resource wins.
    """
    ids = resources.select(F.col("id").alias("resource_id"), F.lit(True).alias("_known"))
    r = requests.join(ids, "resource_id", "left").withColumn("is_available", resource_flag("new_status"))
    reason = first_reason([
        (~nonempty(resources), EMPTY_LIST),
        (F.col("_known").isNull(), "UNKNOWN_RESOURCE"),
    ])
    decisions = decide(r, reason, "request_id", "request_ts", "resource_id", "new_status", "is_available")
    last = decisions.where("accepted").groupBy("resource_id").agg(
        F.max_by(F.struct("new_status", "is_available"), F.struct("request_ts", "request_id")).alias("_last")
    )
    after = resources.join(last.withColumnRenamed("resource_id", "id"), "id", "left").select(
        "id", "name", "type", "quantity", "description",
        F.coalesce(F.col("_last.is_available"), F.col("is_available")).alias("is_available"),
        F.coalesce(F.col("_last.new_status"), F.col("maintenance_status")).alias("maintenance_status"),
    )
    return {"decisions": decisions.drop("request_ts"), "resources_after": after}


def apply_new_resources(requests: DataFrame) -> dict[str, DataFrame]:
    """Add resources; a negative (or missing) quantity is refused. New ones are open and 'Available'."""
    reason = first_reason([(F.col("quantity").isNull() | (F.col("quantity") < 0), "NEGATIVE_QUANTITY")])
    decisions = decide(requests, reason, "request_id", "name", "type", "quantity", "description")
    delta = decisions.where("accepted").select(
        "request_id", "name", "type", "quantity", "description",
        F.lit(1).alias("is_available"), F.lit(NEW_RESOURCE_STATUS).alias("maintenance_status"),
    )
    return {"decisions": decisions.select("request_id", "accepted", "reason"), "resources_delta": delta}


def apply_maintenance(
    resources: DataFrame, bookings: DataFrame, events: DataFrame, requests: DataFrame
) -> dict[str, DataFrame]:
    """Schedule maintenance windows.

    Checks: EMPTY_LIST → UNPARSEABLE → BAD_TIME (end not after start) →
    BOOKED (a booking of an existing event on the resource overlaps) →
    UNKNOWN_RESOURCE. Maintenance never conflicts with maintenance, so the
    requests of a batch are independent. Each accepted window also closes
    its resource ('Under Maintenance', flag 0) at once.
    """
    r = with_span(requests)
    hits = maintenance_booking_conflicts(r, bookings, events).select("request_id", "conflicts")
    ids = resources.select(F.col("id").alias("resource_id"), F.lit(True).alias("_known"))
    r = r.join(hits, "request_id", "left").join(ids, "resource_id", "left")
    reason = first_reason([
        (~nonempty(resources), EMPTY_LIST),
        (unparseable("start_text") | unparseable("end_text") | F.col("start_ts").isNull() | F.col("end_ts").isNull(),
         "UNPARSEABLE"),
        (F.col("end_ts") <= F.col("start_ts"), "BAD_TIME"),
        (F.col("conflicts") > 0, "BOOKED"),
        (F.col("_known").isNull(), "UNKNOWN_RESOURCE"),
    ])
    # Three outputs derive from the decisions: the overlap load is computed once.
    decisions = checkpoint(
        decide(r, reason, "request_id", "resource_id", "start_ts", "end_ts", "description", "conflicts")
    )
    delta = decisions.where("accepted").select(
        "request_id", "resource_id", F.col("start_ts").alias("maintenance_start"),
        F.col("end_ts").alias("maintenance_end"), "description",
    )
    closed = delta.groupBy("resource_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("resource_id", "id")
    after = resources.join(closed, "id", "left").select(
        "id", "name", "type", "quantity", "description",
        F.when(F.col("_n").isNotNull(), F.lit(0)).otherwise(F.col("is_available")).alias("is_available"),
        F.when(F.col("_n").isNotNull(), F.lit(UNDER_MAINTENANCE)).otherwise(F.col("maintenance_status")).alias(
            "maintenance_status"
        ),
    )
    return {
        "decisions": decisions.select("request_id", "resource_id", "conflicts", "accepted", "reason"),
        "maintenance_delta": delta,
        "resources_after": after,
    }
