"""Venue and resource conflicts (time overlap on a shared venue or resource)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import parse_date_time, parse_ts
from campusflow.operators.overlap import first_overlapping, inside_probes, overlap_load, overlapping_pairs, overlapping_pairs_within
from campusflow.plans.common import checkpoint


def with_event_span(requests: DataFrame, date_col: str = "date_text", start_col: str = "start_text",
                    end_col: str = "end_text") -> DataFrame:
    """Parse an event request's date and times into ``start_ts``/``end_ts`` (NULL if unparseable)."""
    return requests.withColumn("start_ts", parse_date_time(date_col, start_col)).withColumn(
        "end_ts", parse_date_time(date_col, end_col)
    )


def with_span(requests: DataFrame, start_col: str = "start_text", end_col: str = "end_text") -> DataFrame:
    """Parse full datetime texts into ``start_ts``/``end_ts`` (NULL if unparseable)."""
    return requests.withColumn("start_ts", parse_ts(start_col)).withColumn("end_ts", parse_ts(end_col))


def venue_conflicts(events: DataFrame) -> DataFrame:
    """Every pair of events at the same venue whose times overlap (a.id < b.id).

    Events without a venue never conflict.
    """
    placed = events.where(F.col("location_id").isNotNull())
    return overlapping_pairs_within(placed, ["location_id"], "id", ("start_ts", "end_ts"), ("event_id_a", "event_id_b"))


def event_request_conflicts(requests: DataFrame, events: DataFrame, location_col: str = "location_id") -> DataFrame:
    """For each request with a valid span: how many stored events at its venue it overlaps."""
    probes = requests.where(F.col("start_ts") < F.col("end_ts")).select(
        "request_id", F.col(location_col).alias("location_id"), "start_ts", "end_ts"
    )
    stored = events.select("location_id", F.col("start_ts").alias("ev_start"), F.col("end_ts").alias("ev_end"))
    out = overlap_load(probes, stored, ["location_id"], "request_id", ("start_ts", "end_ts"), ("ev_start", "ev_end"),
                       out="conflicts")
    return out.select("request_id", "location_id", "conflicts")


def booking_maintenance_conflicts(bookings: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Every stored booking that overlaps a stored maintenance window of its resource."""
    b = bookings.select(F.col("id").alias("booking_id"), "resource_id", "booking_start", "booking_end")
    m = maintenance.select(F.col("id").alias("maintenance_id"), "resource_id", "maintenance_start", "maintenance_end")
    pairs = overlapping_pairs(b, m, ["resource_id"], ("booking_start", "booking_end"),
                              ("maintenance_start", "maintenance_end"))
    return pairs.select("resource_id", "booking_id", "maintenance_id")


def maintenance_booking_conflicts(requests: DataFrame, bookings: DataFrame, events: DataFrame) -> DataFrame:
    """For each maintenance request with a valid span: bookings of its resource that overlap it.

    Only bookings of an existing event count (the booking is joined to its event).
    """
    live = bookings.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    probes = requests.where(F.col("start_ts") < F.col("end_ts")).select("request_id", "resource_id", "start_ts", "end_ts")
    out = overlap_load(probes, live, ["resource_id"], "request_id", ("start_ts", "end_ts"),
                       ("booking_start", "booking_end"), out="conflicts")
    return out.select("request_id", "resource_id", "conflicts")


def maintenance_hits(requests: DataFrame, maintenance: DataFrame) -> DataFrame:
    """For each booking request with a valid span: maintenance windows of its resource it overlaps."""
    probes = requests.where(F.col("start_ts") < F.col("end_ts")).select("request_id", "resource_id", "start_ts", "end_ts")
    out = overlap_load(probes, maintenance, ["resource_id"], "request_id", ("start_ts", "end_ts"),
                       ("maintenance_start", "maintenance_end"), out="maintenance_hits")
    return out.select("request_id", "resource_id", "maintenance_hits")


def booked_in_slot(requests: DataFrame, bookings: DataFrame) -> DataFrame:
    """For each booking request with a valid span: quantity of the resource already
    booked by stored bookings that overlap the slot (0 when none).

    This is the sum over every booking touching the slot, not the peak inside
    it, which is the rule the application applies.
    """
    probes = requests.where(F.col("start_ts") < F.col("end_ts")).select("request_id", "resource_id", "start_ts", "end_ts")
    out = overlap_load(probes, bookings, ["resource_id"], "request_id", ("start_ts", "end_ts"),
                       ("booking_start", "booking_end"), weight="quantity_booked", out="booked")
    return out.select("request_id", "resource_id", "booked")


def resource_remaining(booked: DataFrame, resources: DataFrame) -> DataFrame:
    """Total quantity minus the quantity booked in the slot, per request (known resources only)."""
    r = resources.select(F.col("id").alias("resource_id"), F.col("quantity").alias("total"))
    return booked.join(r, "resource_id", "inner").select(
        "request_id", "resource_id", "total", "booked", (F.col("total") - F.col("booked")).alias("remaining")
    )


def event_request_conflict_names(requests: DataFrame, events: DataFrame) -> DataFrame:
    """For each request with a valid span that overlaps stored events at its
    venue: the first of them (lowest id) and its name, for the refusal message.
    The lowest id comes from the minima of the time index, never from pairs."""
    stored = events.select(F.col("id").alias("event_id"), "location_id", F.col("start_ts").alias("e_s"), F.col("end_ts").alias("e_e"))
    first = first_overlapping(requests, stored, ["location_id"], "request_id", ("start_ts", "end_ts"), ("e_s", "e_e"), "event_id")
    return first.join(events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name")), "event_id").select(
        "request_id", "event_id", "event_name"
    )


def maintenance_conflict_names(requests: DataFrame, bookings: DataFrame, events: DataFrame) -> DataFrame:
    """For each maintenance request with a valid span that overlaps bookings of
    its resource (of existing events): the first such booking (lowest id) and
    its event's name."""
    known = events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"))
    live = bookings.select(F.col("id").alias("booking_id"), "event_id", "resource_id", "booking_start", "booking_end")
    # Read twice below, and joined with the events only where a request can meet it.
    live = inside_probes(live, requests, ["resource_id"], ("booking_start", "booking_end"), ("start_ts", "end_ts"))
    live = checkpoint(live.join(known, "event_id"))
    first = first_overlapping(
        requests, live, ["resource_id"], "request_id", ("start_ts", "end_ts"), ("booking_start", "booking_end"), "booking_id"
    )
    return first.join(live.select("booking_id", "event_name"), "booking_id").select("request_id", "booking_id", "event_name")
