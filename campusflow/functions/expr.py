"""Column expressions shared by reports, rules and request flows.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the source application: text formats, labels and states.
TS_TEXT_FORMAT = "yyyy-M-d H:m:s"  # the application's '%Y-%m-%d %H:%M:%S'
# What that format takes: one or two digits, any blanks between date and time, none outside.
TS_TEXT_FORM = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-( [1-9]|[0-9]{1,2})\s+[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z"
NOT_GIVEN = "N/A"
YES, NO = "Yes", "No"
AVAILABLE_TEXT, NOT_AVAILABLE_TEXT = "Available", "Not Available"
PAYMENT_COMPLETED, PAYMENT_PENDING = "Completed", "Pending"
NEW_EVENT_STATUS = "Scheduled"
UNDER_MAINTENANCE = "Under Maintenance"
NEW_RESOURCE_STATUS = "Available"
STAR = "⭐"
SEMESTER_RANGE = (1, 8)
RATING_RANGE = (1, 5)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_minutes(ts: str | Column, minutes: str | Column) -> Column:
    """``ts + minutes`` for TIMESTAMP_NTZ columns (day-time interval)."""
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), col(minutes).cast("int"))


def parse_ts(text: str | Column) -> Column:
    """Text in the application's datetime format → TIMESTAMP_NTZ, NULL when it does not parse."""
    plain = F.regexp_replace(F.regexp_replace(col(text), r"- ", "-"), r"\s+", " ")
    parsed = F.try_to_timestamp(plain, F.lit(TS_TEXT_FORMAT)).cast("timestamp_ntz")
    return F.when(col(text).rlike(TS_TEXT_FORM), parsed)


def parse_date_time(date_text: str | Column, time_text: str | Column) -> Column:
    """``date`` and ``time`` texts joined by a blank, then parsed (NULL if either is NULL)."""
    return parse_ts(F.concat(col(date_text), F.lit(" "), col(time_text)))


def unparseable(text: str | Column) -> Column:
    """Given text that does not parse as a datetime."""
    return col(text).isNotNull() & parse_ts(text).isNull()


def or_not_given(c: str | Column) -> Column:
    """The application's ``x or 'N/A'``: NULL and empty text both become 'N/A'."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(NOT_GIVEN))


def empty_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def yes_no(flag: str | Column) -> Column:
    """1 → 'Yes'; 0 and NULL → 'No'."""
    return F.when(col(flag) == 1, F.lit(YES)).otherwise(F.lit(NO))


def is_yes(answer: str | Column) -> Column:
    """1 for a typed 'y' in either case, blanks around it aside; else 0."""
    typed = F.lower(F.regexp_replace(col(answer).cast("string"), r"^\s+|\s+$", ""))
    return F.coalesce((typed == "y").cast("int"), F.lit(0))


def availability_text(flag: str | Column) -> Column:
    return F.when(col(flag) == 1, F.lit(AVAILABLE_TEXT)).otherwise(F.lit(NOT_AVAILABLE_TEXT))


def stars(rating: str | Column) -> Column:
    return F.repeat(F.lit(STAR), col(rating))


def resource_flag(status: str | Column) -> Column:
    """1 only when the status text is 'available' in any letter case."""
    return F.when(F.lower(col(status)) == "available", F.lit(1)).otherwise(F.lit(0))


def payment_status(total_price: str | Column, paid: str | Column) -> Column:
    """Free orders complete at once; paid ones complete when paid, else stay pending."""
    return (
        F.when(col(total_price) <= 0, F.lit(PAYMENT_COMPLETED))
        .when(col(paid) == 1, F.lit(PAYMENT_COMPLETED))
        .otherwise(F.lit(PAYMENT_PENDING))
    )


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap: touching ends do not conflict."""
    return (a_start < b_end) & (a_end > b_start)


def first_reason(checks: Iterable[tuple[Column, str]]) -> Column:
    """Reason of the first failing check, NULL when all pass.

    A check whose condition is NULL counts as passed, so each condition must
    state its NULL case itself.
    """
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) for cond, reason in checks])


def request_order() -> list[Column]:
    """Processing order inside one batch of requests."""
    return [F.col("request_ts"), F.col("request_id")]
