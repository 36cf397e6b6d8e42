"""Requests for a unique key as a stream, with the keys taken in the state store.

Of the requests for one key (a student's srn, feedback of a student on an
event) the first valid one is accepted. The batch flows decide that in order
of the request time; here the state store holds, for each key, whether it is
taken and the requests that wait. A request waits until the watermark, the
latest request time seen less ``delay``, has passed it; what came in any order
within the delay is then decided in the batch's order, each key in its own
task and without rereading any table. A request that comes later than the
delay is not dropped: it is decided when it comes, after those decided before.
Requests that come twice are decided once while they wait, and otherwise give
the same refusal or, for the accepted one, nothing again.

Decisions are appended to a Parquet folder by the file sink, exactly once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from campusflow.functions.expr import RATING_RANGE, SEMESTER_RANGE, first_reason
from campusflow.operators.rules import outside
from campusflow.plans.common import EMPTY_LIST
from campusflow.sources.tables import REQUEST_SCHEMAS

DECISION = "key string, request_id long, accepted boolean, reason string, payload string"
_STATE = "taken boolean, winner long, pending string"


def _decide(waiting: list[list], taken: bool, winner: int | None, duplicate: str):
    """Decide requests [time, id, before, after, payload] in order: refused for
    what is checked before uniqueness, for the key, then for the rest."""
    out = []
    for _, rid, before, after, payload in sorted(waiting, key=lambda w: (w[0], w[1])):
        if rid == winner:
            continue
        reason = before or (duplicate if taken else after)
        if reason is None:
            taken, winner = True, rid
        out.append((rid, reason is None, reason, payload))
    return out, taken, winner


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, duplicate: str) -> Iterator[pd.DataFrame]:
    taken, winner, pending = state.get if state.exists else (False, None, "[]")
    waiting = {w[1]: w for w in json.loads(pending)}
    if not state.hasTimedOut:
        for rows in batches:
            rows = rows[rows["real"]]
            times = rows["request_ts"].astype("datetime64[us]").astype("int64")
            for row in zip(times, rows["request_id"], rows["before"], rows["after"], rows["payload"]):
                waiting.setdefault(int(row[1]), [int(row[0]), int(row[1]), *(x if isinstance(x, str) else None for x in row[2:])])
    mark = state.getCurrentWatermarkMs()
    ready = [w for w in waiting.values() if w[0] < mark * 1000]
    out, taken, winner = _decide(ready, taken, None if winner is None or pd.isna(winner) else int(winner), duplicate)
    left = [w for w in waiting.values() if w[0] >= mark * 1000]
    state.update((taken, winner, json.dumps(left)))
    if left:
        state.setTimeoutTimestamp(max(min(w[0] for w in left) // 1000 + 1, mark + 1))
    if out:
        yield pd.DataFrame([(key[0], *d) for d in out], columns=["key", "request_id", "accepted", "reason", "payload"])


def decide_keyed(requests: DataFrame, key: Column, before: Column, after: Column, duplicate: str, delay: str) -> DataFrame:
    """Decisions (DECISION) of a stream of requests (request_id, request_ts,
    ...): ``key`` is what may be taken once (NULL never collides), ``before``
    and ``after`` the reasons checked before and after the key. ``payload`` is
    the request as JSON."""
    # Spark drops rows behind the watermark. The requests themselves therefore
    # have no event time; a tick beside each of them moves the watermark.
    stamp = F.col("request_ts").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    rows = requests.select(
        F.coalesce(key, F.concat(F.lit("\0"), F.col("request_id").cast("string"))).alias("key"),
        "request_id", F.col("request_ts").cast("timestamp").alias("request_ts"), before.alias("before"), after.alias("after"),
        F.to_json(F.struct(*[c for c in requests.columns if not c.startswith("_")])).alias("payload"),
        F.explode(F.array(F.struct(F.lit(True).alias("real"), none.alias("event_time")),
                          F.struct(F.lit(False).alias("real"), stamp.alias("event_time")))).alias("_t"),
    ).select("key", "request_id", "request_ts", "before", "after", "payload", "_t.*").withWatermark("event_time", delay)
    return rows.groupBy("key").applyInPandasWithState(
        lambda k, batches, state: _step(k, batches, state, duplicate), DECISION, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def _start(decisions: DataFrame, out: str, checkpoint_location: str, available_now: bool) -> StreamingQuery:
    writer = decisions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.outputMode("append").start()


def _requests(spark: SparkSession, kind: str, folder: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMAS[kind]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start_student_stream(
    spark: SparkSession, request_dir: str, out: str, checkpoint_location: str, students: DataFrame,
    delay: str = "1 hour", files_per_batch: int = 1, available_now: bool = True,
) -> StreamingQuery:
    """New students (the checks of ``people.apply_new_students``), one per srn."""
    taken = students.where("srn is not null").select("srn", F.lit(True).alias("_taken")).distinct()
    r = _requests(spark, "student_requests", request_dir, files_per_batch)
    columns = r.columns
    r = r.join(taken, "srn", "left")
    before = first_reason([(outside("semester", *SEMESTER_RANGE), "INVALID_SEMESTER"), (F.col("_taken"), "DUPLICATE_SRN")])
    r = r.select(*columns, before.alias("_before"))
    none = F.lit(None).cast("string")
    return _start(decide_keyed(r, F.col("srn"), F.col("_before"), none, "DUPLICATE_SRN", delay), out, checkpoint_location, available_now)


def start_feedback_stream(
    spark: SparkSession, request_dir: str, out: str, checkpoint_location: str, participants: DataFrame, feedback: DataFrame,
    students: DataFrame, events: DataFrame, open_for_feedback: bool = True, delay: str = "1 hour", files_per_batch: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    """Feedback (the checks of ``registrations.feedback_eligibility``), one per
    student and event; the stored tables are as they are at the start.
    ``open_for_feedback``: there are students and completed events."""
    pair = ["event_id", "user_id"]
    part = participants.groupBy(*pair).agg(F.min(F.coalesce("attendance_status", F.lit(1))).alias("_attend"))
    given = feedback.select(*pair, F.lit(True).alias("_given")).distinct()
    known_s = students.select(F.col("id").alias("user_id"), F.lit(True).alias("_student"))
    known_e = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_event"))
    r = _requests(spark, "feedback_requests", request_dir, files_per_batch)
    columns = r.columns
    r = r.join(part, pair, "left").join(given, pair, "left").join(known_s, "user_id", "left").join(known_e, "event_id", "left")
    before = first_reason([
        (F.lit(not open_for_feedback), EMPTY_LIST),
        (F.col("_attend").isNull(), "NOT_PARTICIPANT"),
        (F.col("_attend") == 0, "NOT_ATTENDED"),
        (F.col("_given").isNotNull(), "ALREADY_GIVEN"),
    ])
    after = first_reason([
        (outside("rating", *RATING_RANGE), "BAD_RATING"),
        (F.col("_student").isNull(), "UNKNOWN_STUDENT"),
        (F.col("_event").isNull(), "UNKNOWN_EVENT"),
    ])
    r = r.select(*columns, before.alias("_before"), after.alias("_after"))
    key = F.concat_ws("/", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    known = F.when(F.col("event_id").isNotNull() & F.col("user_id").isNotNull(), key)
    return _start(decide_keyed(r, known, F.col("_before"), F.col("_after"), "ALREADY_GIVEN", delay), out, checkpoint_location, available_now)


def accepted_rows(spark: SparkSession, kind: str, out: str) -> DataFrame:
    """The accepted requests of a stream so far, as a request table."""
    rows = spark.read.schema(DECISION).parquet(out).where("accepted")
    return rows.select(F.from_json("payload", REQUEST_SCHEMAS[kind]).alias("r")).select("r.*")
