"""Keyed request streams decide as the batch flows do, whatever comes late or twice."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from campusflow.plans.people import apply_new_students
from campusflow.sources.tables import REQUEST_SCHEMAS, STATE_SCHEMAS
from campusflow.streaming.keyed_stream import accepted_rows, start_student_stream

T0 = datetime(2024, 3, 1, 9)


def test_students_stream_equals_batch_with_late_and_repeated_requests(spark, scratch):
    rnd = random.Random(4)
    schema = REQUEST_SCHEMAS["student_requests"]
    rows = [(i, T0 + timedelta(minutes=i), f"s{rnd.randint(0, 12)}" if i % 9 else None, "N", rnd.choice([1, 5, 9, None]), "A") for i in range(60)]
    students = spark.createDataFrame([(1, "s3", "N", 2, "A")], STATE_SCHEMAS["students"])
    # Within the delay of half an hour rows come in any order, some twice.
    arrived = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rnd.randint(0, 25)))
    folder = os.path.join(scratch, "in")
    last = (10_000, T0 + timedelta(days=1), "last", "N", 1, "A")
    files = [arrived[:20], arrived[18:40], arrived[35:60], [last]]
    for k, part in enumerate(files):
        written = os.path.join(scratch, f"part{k}")
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(written)
        os.makedirs(folder, exist_ok=True)
        name = next(f for f in os.listdir(written) if f.endswith(".parquet"))
        os.link(os.path.join(written, name), os.path.join(folder, f"{k:03d}.parquet"))
    out = os.path.join(scratch, "out")
    query = start_student_stream(spark, folder, out, os.path.join(scratch, "ckpt"), students, delay="30 minutes")
    query.awaitTermination()
    got = {(r["request_id"], r["accepted"], r["reason"]) for r in spark.read.parquet(out).collect()}
    batch = apply_new_students(students, spark.createDataFrame(rows, schema))
    assert got == {(r["request_id"], r["accepted"], r["reason"]) for r in batch["decisions"].collect()}
    new = {(r["request_id"], r["srn"]) for r in accepted_rows(spark, "student_requests", out).collect()}
    assert new == {(r["request_id"], r["srn"]) for r in batch["students_delta"].collect()}
    # A request later than the delay is decided when it comes: s0 is taken by then or free.
    late = [(20_000, T0, "never seen", "N", 1, "A"), (20_001, T0, "s3", "N", 1, "A")]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(os.path.join(scratch, "late"))
    name = next(f for f in os.listdir(os.path.join(scratch, "late")) if f.endswith(".parquet"))
    os.link(os.path.join(scratch, "late", name), os.path.join(folder, "900.parquet"))
    start_student_stream(spark, folder, out, os.path.join(scratch, "ckpt"), students, delay="30 minutes").awaitTermination()
    got = {r["request_id"]: r["reason"] for r in spark.read.parquet(out).collect()}
    assert got[20_000] is None and got[20_001] == "DUPLICATE_SRN"
