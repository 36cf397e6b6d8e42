"""Reports over all keys at once (the application's list/view screens).

Each takes state DataFrames and returns an unordered DataFrame; ``ordered``
adds the screen's sort order (a range shuffle, needed for presentation only).
The typed-in id of a screen becomes a column, or an optional filter.

Joins are plain equi joins; Spark picks broadcast for the small dimension
side from its measured size (AQE), never from a hint here, since venues,
hosts and students grow with the data too.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import availability_text, or_not_given, stars, yes_no


def _sorted(df: DataFrame, ordered: bool, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


def _as_of(as_of: datetime | Column | None) -> Column:
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz")


def available_venues(venues: DataFrame, ordered: bool = False) -> DataFrame:
    """Venues open for booking (flag = 1), largest first."""
    out = venues.where(F.col("is_available") == 1).select("id", "name", "building", "capacity")
    return _sorted(out, ordered, F.desc("capacity"), "id")


def venues_with_status(venues: DataFrame, ordered: bool = False) -> DataFrame:
    """All venues with their availability in words (NULL flag reads 'Not Available')."""
    out = venues.select(
        "id", "name", "building", "capacity", "is_available", availability_text("is_available").alias("status")
    )
    return _sorted(out, ordered, "name", "id")


def _event_listing(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, keep: Column, time_col: str
) -> DataFrame:
    e = events.where(keep).select(
        F.col("id").alias("event_id"),
        F.col("name").alias("event_name"),
        "date",
        time_col,
        "location_id",
        "organizer_id",
    )
    v = venues.select(F.col("id").alias("location_id"), F.col("name").alias("venue_name"))
    h = hosts.select(F.col("id").alias("organizer_id"), F.col("name").alias("host_name"))
    # venue optional (LEFT), host required (INNER): an event of an unknown host is not listed.
    return (
        e.join(v, "location_id", "left")
        .join(h, "organizer_id", "inner")
        .select(
            "event_id", "event_name", "date", time_col, "venue_name",
            or_not_given("venue_name").alias("venue_label"), "host_name",
        )
    )


def upcoming_events(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, as_of: datetime | None = None, ordered: bool = False
) -> DataFrame:
    """Events whose end is after ``as_of`` (ongoing included); NULL end is in neither list."""
    out = _event_listing(events, venues, hosts, F.col("end_ts") > _as_of(as_of), "start_ts")
    return _sorted(out, ordered, "date", "start_ts", "event_id")


def any_upcoming(events: DataFrame, hosts: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Has a row if ``upcoming_events`` has one: the venue is optional there."""
    later = events.where(F.col("end_ts") > _as_of(as_of)).select("organizer_id")
    return later.join(hosts.select(F.col("id").alias("organizer_id")), "organizer_id", "left_semi")


def completed_events(
    events: DataFrame, venues: DataFrame, hosts: DataFrame, as_of: datetime | None = None, ordered: bool = False
) -> DataFrame:
    """Events whose end is at or before ``as_of``, newest first."""
    out = _event_listing(events, venues, hosts, F.col("end_ts") <= _as_of(as_of), "end_ts")
    return _sorted(out, ordered, F.desc("date"), F.desc("end_ts"), "event_id")


def students_roster(students: DataFrame, ordered: bool = False) -> DataFrame:
    out = students.select("id", "srn", "name", "semester", "section")
    return _sorted(out, ordered, "name", "id")


def event_tickets(tickets: DataFrame, event_id: int | None = None, ordered: bool = False) -> DataFrame:
    """Tickets of one event (or of all events), sold out ones included."""
    out = tickets.select("id", "event_id", "ticket_type", "price", "quantity")
    if event_id is not None:
        out = out.where(F.col("event_id") == event_id)
    return _sorted(out, ordered, "event_id", "id")


def available_tickets(tickets: DataFrame, event_id: int | None = None, ordered: bool = False) -> DataFrame:
    """Tickets still on sale (remaining quantity > 0)."""
    return event_tickets(tickets.where(F.col("quantity") > 0), event_id, ordered)


def feedback_report(
    feedback: DataFrame, students: DataFrame, event_id: int | None = None, ordered: bool = False
) -> DataFrame:
    """Feedback with the student's name and srn; feedback of unknown students is left out."""
    f = feedback if event_id is None else feedback.where(F.col("event_id") == event_id)
    s = students.select(F.col("id").alias("user_id"), F.col("name").alias("student_name"), "srn")
    out = f.join(s, "user_id", "inner").select(
        F.col("id").alias("feedback_id"), "event_id", "student_name", "srn", "rating",
        stars("rating").alias("stars"), "comments",
    )
    return _sorted(out, ordered, "event_id", "feedback_id")


def event_directory(events: DataFrame, ordered: bool = False) -> DataFrame:
    out = events.select("id", "name", "date")
    return _sorted(out, ordered, F.desc("date"), "id")


def attendance_roster(
    participants: DataFrame, students: DataFrame, event_id: int | None = None, ordered: bool = False
) -> DataFrame:
    """Registered students of each event with 'Yes'/'No' attendance (NULL reads 'No')."""
    p = participants if event_id is None else participants.where(F.col("event_id") == event_id)
    s = students.select(F.col("id").alias("user_id"), "name", "srn")
    out = p.join(s, "user_id", "inner").select(
        "event_id", F.col("user_id").alias("student_id"), "name", "srn", yes_no("attendance_status").alias("attended")
    )
    return _sorted(out, ordered, "event_id", "name", "student_id")


def participants_detail(
    participants: DataFrame, events: DataFrame, students: DataFrame, ordered: bool = False
) -> DataFrame:
    """Every registration with event and student names; orphans on either side are left out."""
    e = events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"))
    s = students.select(F.col("id").alias("user_id"), F.col("name").alias("student_name"), "srn")
    out = (
        participants.join(e, "event_id", "inner")
        .join(s, "user_id", "inner")
        .select(
            "event_id", "event_name", "user_id", "student_name", "srn", "registration_time",
            yes_no("attendance_status").alias("attended"),
        )
    )
    return _sorted(out, ordered, "event_name", "student_name", "event_id", "user_id")


def participant_counts(participants: DataFrame, events: DataFrame, ordered: bool = False) -> DataFrame:
    """Registrations per event (events without any are absent; same-name events stay apart).

    Counted per event before the join, so the shuffle carries one partial
    count per event and key instead of every registration.
    """
    counts = participants.groupBy("event_id").agg(F.count("user_id").alias("participant_count"))
    e = events.select(F.col("id").alias("event_id"), "name")
    out = counts.join(e, "event_id", "inner").select("event_id", "name", "participant_count")
    return _sorted(out, ordered, F.desc("participant_count"), "event_id")


def resources_list(resources: DataFrame, ordered: bool = False) -> DataFrame:
    out = resources.select("id", "name", "type", "quantity", "maintenance_status")
    return _sorted(out, ordered, "name", "id")


def hosts_list(hosts: DataFrame, ordered: bool = False) -> DataFrame:
    out = hosts.select("id", "name", "department", "role")
    return _sorted(out, ordered, "name", "id")


def upcoming_registrations(
    participants: DataFrame, events: DataFrame, venues: DataFrame, as_of: datetime | None = None,
    user_id: int | None = None, ordered: bool = False,
) -> DataFrame:
    """Each student's registrations for events that have not ended, venue or 'N/A'."""
    p = participants if user_id is None else participants.where(F.col("user_id") == user_id)
    e = events.where(F.col("end_ts") > _as_of(as_of)).select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name"), "date", "start_ts", "location_id"
    )
    v = venues.select(F.col("id").alias("location_id"), F.col("name").alias("venue_name"))
    out = (
        p.select("event_id", "user_id")
        .join(e, "event_id", "inner")
        .join(v, "location_id", "left")
        .select("user_id", "event_id", "event_name", "date", "start_ts", or_not_given("venue_name").alias("venue_label"))
    )
    return _sorted(out, ordered, "user_id", "date", "event_id")


def unknown_student_requests(requests: DataFrame, students: DataFrame, ordered: bool = False) -> DataFrame:
    """Requests naming a student id that does not exist (the login check)."""
    s = students.select(F.col("id").alias("user_id"))
    return _sorted(requests.join(s, "user_id", "left_anti").select("request_id", "user_id"), ordered, "request_id")
