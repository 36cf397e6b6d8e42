"""Attendance marking and feedback flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import RATING_RANGE, first_reason
from campusflow.operators.reports import completed_events
from campusflow.operators.rules import outside
from campusflow.plans.common import checkpoint, decide, EMPTY_LIST, nonempty, order_key

KEY = ["event_id", "user_id"]


def apply_attendance(
    events: DataFrame, participants: DataFrame, students: DataFrame, requests: DataFrame
) -> dict[str, DataFrame]:
    """Mark (event, student) registrations as attended.

    Checks: EMPTY_LIST (no events) → NO_REGISTRATIONS (the event's roster of
    registered students is empty) → NOT_REGISTERED (no row for the pair).
    Marking is idempotent, so the requests of a batch are independent.
    """
    roster = (
        participants.join(students.select(F.col("id").alias("user_id")), "user_id", "left_semi")
        .groupBy("event_id").agg(F.count(F.lit(1)).alias("_roster"))
    )
    pairs = participants.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"))
    r = requests.join(roster, "event_id", "left").join(pairs, KEY, "left")
    reason = first_reason([
        (~nonempty(events), EMPTY_LIST),
        (F.col("_roster").isNull(), "NO_REGISTRATIONS"),
        (F.col("_rows").isNull(), "NOT_REGISTERED"),
    ])
    decisions = decide(r, reason, "request_id", *KEY)
    marked = decisions.where("accepted").groupBy(*KEY).agg(F.lit(True).alias("_marked"))
    after = participants.join(marked, KEY, "left").select(
        *KEY, "registration_time",
        F.when(F.col("_marked"), F.lit(1)).otherwise(F.col("attendance_status")).alias("attendance_status"),
    )
    return {"decisions": decisions, "participants_after": after}


def feedback_eligibility(
    requests: DataFrame, participants: DataFrame, feedback: DataFrame, students: DataFrame,
    events: DataFrame, venues: DataFrame, hosts: DataFrame, as_of,
) -> DataFrame:
    """Decide feedback requests in batch order.

    Checks: EMPTY_LIST (no students, or no completed events) →
    NOT_PARTICIPANT → NOT_ATTENDED (attendance 0; NULL passes) →
    ALREADY_GIVEN (stored feedback for the pair, or an earlier accepted
    request of the batch) → BAD_RATING (not 1..5) → UNKNOWN_STUDENT /
    UNKNOWN_EVENT (the insert's references). The event itself is not checked
    to be completed.

    Per pair, the first request that passes every check is accepted and the
    later ones are ALREADY_GIVEN: a grouped min per pair, no ordering window.
    """
    part = participants.groupBy(*KEY).agg(
        F.min(F.coalesce(F.col("attendance_status"), F.lit(1))).alias("_attend")
    )
    given = feedback.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_given"))
    known_s = students.select(F.col("id").alias("user_id"), F.lit(True).alias("_student"))
    known_e = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_event"))
    gate = nonempty(students) & nonempty(completed_events(events, venues, hosts, as_of))
    r = (
        requests.join(part, KEY, "left").join(given, KEY, "left")
        .join(known_s, "user_id", "left").join(known_e, "event_id", "left")
        .withColumn("_gate", gate)
        .withColumn("_ord", order_key())
    )
    static = first_reason([
        (~F.col("_gate"), EMPTY_LIST),
        (F.col("_attend").isNull(), "NOT_PARTICIPANT"),
        (F.col("_attend") == 0, "NOT_ATTENDED"),
        (F.col("_given").isNotNull(), "ALREADY_GIVEN"),
    ])
    rating_bad = outside("rating", *RATING_RANGE)
    passes = static.isNull() & ~rating_bad & F.col("_student").isNotNull() & F.col("_event").isNotNull()
    r = r.withColumn("_static", static).withColumn("_passes", passes)
    first_ok = r.where("_passes").groupBy(*KEY).agg(F.min("_ord").alias("_first"))
    r = r.join(first_ok, KEY, "left")
    reason = F.coalesce(
        F.col("_static"),
        first_reason([
            (F.col("_first") < F.col("_ord"), "ALREADY_GIVEN"),
            (rating_bad, "BAD_RATING"),
            (F.col("_student").isNull(), "UNKNOWN_STUDENT"),
            (F.col("_event").isNull(), "UNKNOWN_EVENT"),
        ]),
    )
    return decide(r, reason, "request_id", "request_ts", *KEY, "rating", "comments")


def apply_feedback(
    requests: DataFrame, participants: DataFrame, feedback: DataFrame, students: DataFrame,
    events: DataFrame, venues: DataFrame, hosts: DataFrame, as_of,
) -> dict[str, DataFrame]:
    """Feedback eligibility, then the rows to insert (submitted at the request time)."""
    d = checkpoint(feedback_eligibility(requests, participants, feedback, students, events, venues, hosts, as_of))
    delta = d.where("accepted").select(
        "request_id", *KEY, "rating", "comments", F.col("request_ts").alias("submitted_at")
    )
    return {"decisions": d.select("request_id", *KEY, "accepted", "reason"), "feedback_delta": delta}
