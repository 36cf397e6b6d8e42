"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Each one builds the stand-in domain tables over the test tables of
``sf_dir`` and runs one library operator on all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.operators import conflicts as C
from campusflow.operators import reports as R
from campusflow.operators import rules as V
from campusflow.operators.prefix import placed
from campusflow.plans import assets as PA
from campusflow.plans import bookings as PB
from campusflow.plans import events as PE
from campusflow.plans import orders as PO
from campusflow.plans import people as PP
from campusflow.plans import registrations as PR
from campusflow.plans import tickets as PT
from campusflow.sources.fixtures import AS_OF, FixtureTables
from campusflow.sources.tables import typed_rows

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[[FixtureTables], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[FixtureTables], DataFrame]):
        _REGISTRY[name] = fn
        return fn

    return deco


def portable(df: DataFrame) -> DataFrame:
    """DATE columns as ISO text, so that results compare the same in any client."""
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def fixtures(spark: SparkSession, sf_dir: str) -> FixtureTables:
    """The stand-in tables over a folder, derived anew by every query."""
    return FixtureTables(spark, sf_dir)


def all_queries() -> dict[str, Query]:
    def bind(fn: Callable[[FixtureTables], DataFrame]) -> Query:
        return lambda spark, sf_dir: portable(fn(fixtures(spark, sf_dir)))

    return {name: bind(fn) for name, fn in _REGISTRY.items()}


# --------------------------------------------------------------- reports
register("available_venues")(lambda t: R.available_venues(t.venues))
register("venues_with_status")(lambda t: R.venues_with_status(t.venues))
register("upcoming_events")(lambda t: R.upcoming_events(t.events, t.venues, t.hosts, AS_OF))
register("completed_events")(lambda t: R.completed_events(t.events, t.venues, t.hosts, AS_OF))
register("students_roster")(lambda t: R.students_roster(t.students))
register("available_tickets")(lambda t: R.available_tickets(t.tickets))
register("event_tickets")(lambda t: R.event_tickets(t.tickets))
register("feedback_report")(lambda t: R.feedback_report(t.feedback, t.students))
register("event_directory")(lambda t: R.event_directory(t.events))
register("attendance_roster")(lambda t: R.attendance_roster(t.participants, t.students))
register("participants_detail")(lambda t: R.participants_detail(t.participants, t.events, t.students))
register("participant_counts")(lambda t: R.participant_counts(t.participants, t.events))
register("resources_list")(lambda t: R.resources_list(t.resources))
register("hosts_list")(lambda t: R.hosts_list(t.hosts))
register("upcoming_registrations")(
    lambda t: R.upcoming_registrations(t.participants, t.events, t.venues, AS_OF)
)
register("unknown_student_requests")(lambda t: R.unknown_student_requests(t.order_requests, t.students))



def _roster_order(t: FixtureTables) -> DataFrame:
    roster = placed(R.attendance_roster(t.participants, t.students, ordered=True).select("event_id", "student_id", "name"))
    first = roster.groupBy("event_id").agg(F.min("position").alias("_first"))
    return roster.join(first, "event_id").select("event_id", "student_id", "name", (F.col("position") - F.col("_first") + 1).alias("position"))


# The places of the rows in the sorted reports themselves.
register("attendance_roster_order")(_roster_order)
register("event_directory_order")(lambda t: placed(R.event_directory(t.events, ordered=True)).select("id", "name", "position"))
register("upcoming_events_order")(
    lambda t: placed(R.upcoming_events(t.events, t.venues, t.hosts, AS_OF, ordered=True)).select(F.col("event_id").alias("id"), "position")
)
register("completed_events_order")(
    lambda t: placed(R.completed_events(t.events, t.venues, t.hosts, AS_OF, ordered=True)).select(F.col("event_id").alias("id"), "position")
)
register("participant_counts_order")(
    lambda t: placed(R.participant_counts(t.participants, t.events, ordered=True)).select("event_id", "participant_count", "position")
)

# ------------------------------------------------------- overlap conflicts

register("venue_conflicts")(lambda t: C.venue_conflicts(t.events))
register("event_request_conflicts")(
    lambda t: C.event_request_conflicts(C.with_event_span(t.event_requests), t.events)
)
register("booking_maintenance_conflicts")(lambda t: C.booking_maintenance_conflicts(t.bookings, t.maintenance))
register("maintenance_booking_conflicts")(
    lambda t: C.maintenance_booking_conflicts(C.with_span(t.maintenance_requests), t.bookings, t.events)
)
register("booked_in_slot")(lambda t: C.booked_in_slot(C.with_span(t.booking_requests), t.bookings))
register("resource_remaining")(
    lambda t: C.resource_remaining(C.booked_in_slot(C.with_span(t.booking_requests), t.bookings), t.resources)
)

# ------------------------------------------------------------------ rules

register("invalid_semester")(lambda t: V.invalid_semester(t.students))
register("invalid_rating")(lambda t: V.invalid_rating(t.feedback))
register("invalid_intervals")(
    lambda t: V.invalid_spans(t.events, "events", "id", "start_ts", "end_ts")
    .unionByName(V.invalid_spans(t.bookings, "bookings", "id", "booking_start", "booking_end"))
    .unionByName(V.invalid_spans(t.maintenance, "maintenance", "id", "maintenance_start", "maintenance_end"))
    .unionByName(V.invalid_spans(C.with_event_span(t.event_requests), "event_requests", "request_id", "start_ts", "end_ts"))
    .unionByName(V.invalid_spans(C.with_span(t.booking_requests), "booking_requests", "request_id", "start_ts", "end_ts"))
    .unionByName(
        V.invalid_spans(C.with_span(t.maintenance_requests), "maintenance_requests", "request_id", "start_ts", "end_ts")
    )
)
register("over_capacity_events")(lambda t: V.over_capacity_events(t.events, t.venues))
register("requests_bad_ticket")(lambda t: V.requests_bad_ticket(t.order_requests, t.tickets_unset))
register("unfillable_requests")(lambda t: V.unfillable_requests(t.order_requests, t.tickets))
register("invalid_booking_quantity")(lambda t: V.invalid_booking_quantity(t.booking_requests, t.resources))
register("invalid_resource_quantity")(lambda t: V.invalid_resource_quantity(t.resource_requests))
register("invalid_flags")(lambda t: V.invalid_flags(t.venue_flag_requests, "request_id", "new_status"))
register("duplicate_keys")(lambda t: V.duplicate_keys(t.students, t.hosts, t.participants))
register("orphan_rows")(
    lambda t: V.orphan_rows(t.participants, t.feedback, t.bookings, t.orders, t.students, t.events, t.tickets, t.resources)
)
register("requests_bad_venue")(lambda t: V.requests_bad_venue(t.event_requests, t.venues))
register("unparseable_requests")(
    lambda t: V.unparseable_requests({
        "event_requests": (t.event_requests, ["date_text+start_text", "date_text+end_text"]),
        "event_update_requests": (t.event_update_requests, ["new_date_text+new_start_text", "new_date_text+new_end_text"]),
        "booking_requests": (t.booking_requests, ["start_text", "end_text"]),
        "maintenance_requests": (t.maintenance_requests, ["start_text", "end_text"]),
    })
)
register("typed_order_requests")(
    lambda t: typed_rows("order_requests", t.order_request_texts, ("paid",))[0].withColumn(
        "how_many", F.col("how_many").cast("string")  # holds NULLs, see events_after_update
    )
)
register("order_request_rejects")(lambda t: typed_rows("order_requests", t.order_request_texts, ("paid",))[1])
register("lowest_ticket")(lambda t: V.lowest_ticket(t.tickets))
register("first_feedback")(lambda t: V.first_feedback(t.feedback, t.participants))

# ----------------------------------------------------------- request flows


def _orders(t: FixtureTables) -> dict[str, DataFrame]:
    return PO.apply_orders(t.tickets_unset, t.participants, t.students, t.events, t.venues, t.hosts, t.order_requests, AS_OF)


def _cancels(t: FixtureTables) -> dict[str, DataFrame]:
    return PO.apply_cancellations(t.participants, t.events, t.tickets, t.orders, t.cancel_requests, AS_OF)


def _feedback(t: FixtureTables) -> dict[str, DataFrame]:
    return PR.apply_feedback(t.feedback_requests, t.participants, t.feedback, t.students, t.events, t.venues, t.hosts,
                             AS_OF)


register("order_decisions")(lambda t: _orders(t)["decisions"])
register("ticket_stock_after")(
    lambda t: _orders(t)["tickets_after"].withColumn("quantity", F.col("quantity").cast("string"))  # holds NULLs
)
register("orders_delta")(lambda t: _orders(t)["orders_delta"])
register("order_payment_status")(lambda t: PO.order_payment_status(t.order_requests, t.tickets))
register("order_total_text")(lambda t: PO.order_total_text(t.order_requests, t.tickets))
register("cancel_decisions")(lambda t: _cancels(t)["decisions"])
register("refunds_by_ticket")(lambda t: _cancels(t)["refunds_by_ticket"])
register("orders_of_cancelled")(lambda t: _cancels(t)["orders_removed"])
register("attendance_decisions")(
    lambda t: PR.apply_attendance(t.events, t.participants, t.students, t.attendance_requests)["decisions"]
)
register("attendance_after")(
    lambda t: PR.apply_attendance(t.events, t.participants, t.students, t.attendance_requests)["participants_after"]
    .withColumn("attendance_status", F.col("attendance_status").cast("string"))  # holds NULLs
)
register("venue_flag_decisions")(lambda t: PA.apply_venue_flags(t.venues, t.venue_flag_requests)["decisions"])
register("venues_after")(lambda t: PA.apply_venue_flags(t.venues, t.venue_flag_requests)["venues_after"])
register("resource_flag")(lambda t: PA.apply_resource_status(t.resources, t.resource_status_requests)["decisions"])
register("resources_after")(
    lambda t: PA.apply_resource_status(t.resources, t.resource_status_requests)["resources_after"]
)
register("resources_delta")(lambda t: PA.apply_new_resources(t.resource_requests)["resources_delta"])
register("maintenance_decisions")(
    lambda t: PA.apply_maintenance(t.resources, t.bookings, t.events, t.maintenance_requests)["decisions"].withColumn(
        "conflicts", F.coalesce("conflicts", F.lit(0))
    )
)
register("resources_after_maintenance")(
    lambda t: PA.apply_maintenance(t.resources, t.bookings, t.events, t.maintenance_requests)["resources_after"]
)
register("feedback_eligibility")(lambda t: _feedback(t)["decisions"])
register("feedback_delta")(lambda t: _feedback(t)["feedback_delta"])
register("unique_students")(lambda t: PP.apply_new_students(t.students, t.student_requests)["decisions"])
register("host_decisions")(lambda t: PP.apply_new_hosts(t.hosts, t.host_requests)["decisions"])
register("tickets_after_update")(
    lambda t: PT.apply_ticket_changes(t.tickets, t.ticket_requests, t.events)["tickets_after"]
)
register("tickets_added")(lambda t: PT.apply_ticket_changes(t.tickets, t.ticket_requests, t.events)["tickets_delta"])


def _new_events(t: FixtureTables) -> dict[str, DataFrame]:
    return PE.apply_new_events(t.events, t.venues, t.hosts, t.event_requests)


def _bookings(t: FixtureTables) -> dict[str, DataFrame]:
    return PB.apply_bookings(t.events, t.venues, t.hosts, t.resources, t.bookings, t.maintenance, t.booking_requests,
                             AS_OF)


register("event_admission")(lambda t: _new_events(t)["decisions"])
register("events_delta")(lambda t: _new_events(t)["events_delta"])
register("event_update_decisions")(
    lambda t: PE.apply_event_updates(t.events, t.venues, t.hosts, t.event_update_requests, AS_OF)["decisions"]
)
register("booking_decisions")(lambda t: _bookings(t)["decisions"])
register("booking_check")(
    lambda t: PB.booking_check(t.events, t.venues, t.hosts, t.resources, t.bookings, t.maintenance,
                               t.booking_requests, AS_OF).select("request_id", "resource_id", "reason")
)

register("event_request_conflict_names")(
    lambda t: C.event_request_conflict_names(C.with_event_span(t.event_requests), t.events)
)
register("maintenance_conflict_names")(
    lambda t: C.maintenance_conflict_names(C.with_span(t.maintenance_requests), t.bookings, t.events)
)
# location_id holds NULLs (events without a venue); integer columns with NULLs
# convert to floats on Spark's pandas side but to nullable integers on
# DuckDB's, so this output gives the id as text on both sides.
register("events_after_update")(
    lambda t: PE.apply_event_updates(t.events, t.venues, t.hosts, t.event_update_requests, AS_OF)["events_after"]
    .withColumn("location_id", F.col("location_id").cast("string"))
)
register("students_delta")(lambda t: PP.apply_new_students(t.students, t.student_requests)["students_delta"])
register("hosts_delta")(lambda t: PP.apply_new_hosts(t.hosts, t.host_requests)["hosts_delta"])
register("bookings_delta")(lambda t: _bookings(t)["bookings_delta"])
register("maintenance_delta")(
    lambda t: PA.apply_maintenance(t.resources, t.bookings, t.events, t.maintenance_requests)["maintenance_delta"]
)
register("participants_delta")(
    lambda t: _orders(t)["participants_delta"].withColumn("attendance_status", F.col("attendance_status").cast("string"))
)
