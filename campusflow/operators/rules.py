"""Data-quality rules: each returns the violating rows of a table or request set.

The same checks are the first stage of the request flows in ``plans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import RATING_RANGE, SEMESTER_RANGE, first_reason, unparseable


def outside(c: str | Column, lo: int, hi: int) -> Column:
    """Value missing or outside [lo, hi]."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.between(lo, hi)


def invalid_semester(students: DataFrame) -> DataFrame:
    """Students (or student requests) whose semester is not 1..8."""
    id_col = "id" if "id" in students.columns else "request_id"
    return students.where(outside("semester", *SEMESTER_RANGE)).select(id_col, "srn", "semester")


def invalid_rating(feedback: DataFrame) -> DataFrame:
    """Feedback whose rating is not 1..5."""
    return feedback.where(outside("rating", *RATING_RANGE)).select("id", "event_id", "user_id", "rating")


def invalid_spans(df: DataFrame, source: str, id_col: str, start: str, end: str) -> DataFrame:
    """Rows whose interval is missing or does not end after it starts."""
    bad = F.col(start).isNull() | F.col(end).isNull() | (F.col(end) <= F.col(start))
    return df.where(bad).select(
        F.lit(source).alias("source"), F.col(id_col).alias("row_id"),
        F.col(start).alias("start_ts"), F.col(end).alias("end_ts"),
    )


def over_capacity_events(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events that allow more participants than their venue holds."""
    v = venues.select(F.col("id").alias("location_id"), "capacity")
    return (
        events.join(v, "location_id", "inner")
        .where(F.col("max_participants") > F.col("capacity"))
        .select(F.col("id").alias("event_id"), "location_id", "max_participants", "capacity")
    )


def _event_ticket(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    t = tickets.select(F.col("id").alias("ticket_id"), F.col("event_id").alias("_t_event"), "quantity")
    return requests.join(t, "ticket_id", "left")


def requests_bad_ticket(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """Order requests whose ticket is not on sale for the requested event
    (missing, of another event, or with no stock left)."""
    r = _event_ticket(requests, tickets)
    on_sale = F.coalesce(F.col("quantity") > 0, F.lit(False))
    bad = F.col("_t_event").isNull() | (F.col("_t_event") != F.col("event_id")) | ~on_sale
    return r.where(bad).select("request_id", "event_id", "ticket_id")


def unfillable_requests(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """Order requests for a ticket on sale whose count is below 1 or above the stock."""
    r = _event_ticket(requests, tickets).where((F.col("_t_event") == F.col("event_id")) & (F.col("quantity") > 0))
    bad = (F.col("how_many") <= 0) | (F.col("how_many") > F.col("quantity"))
    return r.where(bad).select("request_id", "ticket_id", "how_many", "quantity")


def invalid_booking_quantity(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Booking requests asking for more than the resource has in total, or for fewer than 1."""
    r = requests.join(resources.select(F.col("id").alias("resource_id"), F.col("quantity").alias("total")),
                      "resource_id", "inner")
    reason = first_reason([
        (F.col("quantity").isNull() | (F.col("quantity") > F.col("total")), "OVER_TOTAL"),
        (F.col("quantity") <= 0, "NON_POSITIVE"),
    ])
    return r.select("request_id", "resource_id", "quantity", "total", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def invalid_resource_quantity(resources: DataFrame) -> DataFrame:
    """Resources (or resource requests) with a negative or missing quantity."""
    id_col = "id" if "id" in resources.columns else "request_id"
    return resources.where(F.col("quantity").isNull() | (F.col("quantity") < 0)).select(id_col, "name", "quantity")


def invalid_flags(df: DataFrame, id_col: str, flag_col: str) -> DataFrame:
    """Rows whose 0/1 flag holds anything else."""
    return df.where(F.col(flag_col).isNull() | ~F.col(flag_col).isin(0, 1)).select(id_col, flag_col)


def duplicate_keys(students: DataFrame, hosts: DataFrame, participants: DataFrame) -> DataFrame:
    """Values of the unique keys held by more than one row: srn, host email,
    host phone (NULL exempt), (event, student) registration."""
    def dups(df: DataFrame, key_name: str, value: Column) -> DataFrame:
        return (
            df.select(value.alias("key_value"))
            .where(F.col("key_value").isNotNull())
            .groupBy("key_value")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .select(F.lit(key_name).alias("key_name"), "key_value", "n")
        )

    return (
        dups(students, "srn", F.col("srn"))
        .unionByName(dups(hosts, "email", F.col("email")))
        .unionByName(dups(hosts, "phone", F.col("phone")))
        .unionByName(dups(participants, "registration",
                          F.concat_ws("/", F.col("event_id").cast("string"), F.col("user_id").cast("string"))))
    )


def orphan_rows(
    participants: DataFrame, feedback: DataFrame, bookings: DataFrame, orders: DataFrame,
    students: DataFrame, events: DataFrame, tickets: DataFrame, resources: DataFrame,
) -> DataFrame:
    """Rows whose reference to a student, event, ticket or resource finds nothing."""
    def missing(df: DataFrame, table: str, row_key: Column, ref_col: str, ref_name: str, target: DataFrame) -> DataFrame:
        ids = target.select(F.col("id").alias(ref_col))
        return df.join(ids, ref_col, "left_anti").select(
            F.lit(table).alias("table_name"), row_key.alias("row_key"), F.lit(ref_name).alias("missing_ref"),
            F.col(ref_col).alias("ref_id"),
        )

    p_key = F.concat_ws("/", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return (
        missing(participants, "participants", p_key, "user_id", "student", students)
        .unionByName(missing(participants, "participants", p_key, "event_id", "event", events))
        .unionByName(missing(feedback, "feedback", F.col("id").cast("string"), "user_id", "student", students))
        .unionByName(missing(feedback, "feedback", F.col("id").cast("string"), "event_id", "event", events))
        .unionByName(missing(bookings, "bookings", F.col("id").cast("string"), "event_id", "event", events))
        .unionByName(missing(bookings, "bookings", F.col("id").cast("string"), "resource_id", "resource", resources))
        .unionByName(missing(orders, "orders", F.col("order_id").cast("string"), "ticket_id", "ticket", tickets))
        .unionByName(missing(orders, "orders", F.col("order_id").cast("string"), "user_id", "student", students))
    )


def requests_bad_venue(requests: DataFrame, venues: DataFrame, location_col: str = "location_id") -> DataFrame:
    """Requests naming a venue that is not on the available list."""
    open_ids = venues.where(F.col("is_available") == 1).select(F.col("id").alias(location_col))
    return requests.join(open_ids, location_col, "left_anti").select("request_id", location_col)


def unparseable_requests(sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Given texts that do not parse as datetimes: one row per (source, request, field).

    ``sources`` maps a source name to (requests, text columns); a column may be
    ``"date_text+start_text"`` for a date and a time joined by a blank.
    """
    parts = []
    for source, (df, fields) in sources.items():
        for field in fields:
            if "+" in field:
                d, t = field.split("+")
                text = F.concat(F.col(d), F.lit(" "), F.col(t))
            else:
                text = F.col(field)
            parts.append(
                df.where(unparseable(text)).select(
                    F.lit(source).alias("source"), "request_id", F.lit(field).alias("field")
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lowest_ticket(tickets: DataFrame) -> DataFrame:
    """Each event's lowest ticket id (the one a refund goes to).

    A grouped min (partial aggregation), not a ranking window.
    """
    return tickets.groupBy("event_id").agg(F.min("id").alias("ticket_id"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The first row per key by ``order``: a grouped min of a struct, which
    aggregates partially before the shuffle instead of ranking whole groups."""
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols if c not in order and c not in keys])
    return df.groupBy(*keys).agg(F.min(packed).alias("_first")).select(*keys, "_first.*").select(*keys, *[
        c for c in cols if c not in keys
    ])


def first_feedback(feedback: DataFrame, participants: DataFrame) -> DataFrame:
    """Stored feedback that passes the eligibility rule (registered, attendance
    not 0 — NULL passes), first per (event, student) by submission time."""
    ok = participants.where(F.coalesce(F.col("attendance_status"), F.lit(1)) != 0).select("event_id", "user_id")
    eligible = feedback.join(ok, ["event_id", "user_id"], "left_semi")
    return first_per_key(eligible, ["event_id", "user_id"], ["submitted_at", "id"],
                         ["event_id", "user_id", "submitted_at", "id", "rating"])
