"""New students and hosts: admission under unique keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions.expr import SEMESTER_RANGE, empty_to_null, first_reason
from campusflow.operators.components import components, linked_by
from campusflow.operators.prefix import running_sums
from campusflow.operators.rules import outside
from campusflow.plans.common import checkpoint, decide, order_key, order_ranges, whole_groups

#: Requests of a component that one task decides one after the other.
FOLD = 10_000


def apply_new_students(students: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Add students.

    Checks: INVALID_SEMESTER (not 1..8) → DUPLICATE_SRN (srn held by a stored
    student, or by an earlier accepted request). A refused request takes no
    srn, so per srn the first request with a valid semester wins: a grouped
    min per srn, no ordering window. A NULL srn never collides.
    """
    taken = students.where(F.col("srn").isNotNull()).groupBy("srn").agg(F.lit(True).alias("_taken"))
    r = requests.withColumn("_ord", order_key()).join(taken, "srn", "left")
    sem_bad = outside("semester", *SEMESTER_RANGE)
    first = r.where(~sem_bad & F.col("_taken").isNull() & F.col("srn").isNotNull()).groupBy("srn").agg(
        F.min("_ord").alias("_first")
    )
    r = r.join(first, "srn", "left")
    reason = first_reason([
        (sem_bad, "INVALID_SEMESTER"),
        (F.col("_taken").isNotNull() | (F.col("_first") < F.col("_ord")), "DUPLICATE_SRN"),
    ])
    decisions = decide(r, reason, "request_id", "srn", "name", "semester", "section")
    delta = decisions.where("accepted").select("request_id", "srn", "name", "semester", "section")
    return {"decisions": decisions.select("request_id", "srn", "accepted", "reason"), "students_delta": delta}


def _own(key: str) -> Column:
    """A join key that equals another one only for equal, non-NULL values: NULL
    keys are spread by request instead of meeting in one task."""
    return F.struct(F.col(key).isNull().alias("null"), F.coalesce(key, F.col("request_id").cast("string")).alias("value"))


def _given(rows: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """(_key, out) per value of ``key``: an aggregate over the rows that have one."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias(out)).select(
        F.struct(F.lit(False).alias("null"), F.col(key).alias("value")).alias("_key"), out
    )


def _marked(rows: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    return rows.withColumn("_key", _own(key)).join(marks, "_key", "left").drop("_key")


def _easy_round(und: DataFrame) -> DataFrame:
    """One pass over undecided requests: those first on both keys are accepted,
    those that share a key with one of them are refused."""
    s = und
    for key, out in (("email", "_fe"), ("phone", "_fp")):
        s = _marked(s, key, _given(und, key, F.min("_ord"), out))
    first = (F.col("email").isNull() | (F.col("_fe") == F.col("_ord"))) & (F.col("phone").isNull() | (F.col("_fp") == F.col("_ord")))
    s = checkpoint(s.withColumn("_acc", F.when(first, F.lit(True))).drop("_fe", "_fp"))
    won = s.where("_acc")
    for key, out in (("email", "_we"), ("phone", "_wp")):
        s = _marked(s, key, _given(won, key, F.lit(True), out))
    lost = F.col("_acc").isNull() & (F.col("_we").isNotNull() | F.col("_wp").isNotNull())
    return checkpoint(s.withColumn("_acc", F.when(lost, F.lit(False)).otherwise(F.col("_acc"))).drop("_we", "_wp"))


def _decide_one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide the requests of whole components in batch order. Components share
    no key, so the keys taken are those of the rows at hand."""
    for rows in whole_groups(batches, ["component"]):
        taken: set[tuple[str, str]] = set()
        accepted = []
        for email, phone in zip(rows["email"], rows["phone"]):
            own = {(k, v) for k, v in (("email", email), ("phone", phone)) if isinstance(v, str)}
            accepted.append(not own & taken)
            if accepted[-1]:
                taken |= own
        yield pd.DataFrame({"request_id": rows["request_id"], "accepted": accepted})


def _by_component(und: DataFrame) -> DataFrame:
    """(request_id, accepted) for requests of which some share keys.

    Requests that share an email or a phone, directly or through others, form
    a component. One of at most FOLD requests is decided in a task, one request
    after the other, however long its chain of shared keys; of a larger one
    the first FOLD in batch order are (nothing undecided comes before them),
    and the requests that share a key with an accepted one are refused.
    """
    done, columns = [], und.columns
    while True:
        keys = und.select("request_id", F.explode(F.array_compact(F.array(
            F.when(F.col("email").isNotNull(), F.struct(F.lit("email").alias("k"), F.col("email").alias("v"))),
            F.when(F.col("phone").isNotNull(), F.struct(F.lit("phone").alias("k"), F.col("phone").alias("v"))),
        ))).alias("_key"))
        named = components(linked_by(keys, "request_id", "_key")).withColumnRenamed("id", "request_id")
        placed = checkpoint(und.join(named, "request_id"))
        large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FOLD).select("component")
        many = large.limit(1).count() > 0
        heads = placed
        if many:
            ranked = order_ranges(placed.join(large, "component", "left_semi"), ["component"], ["_ord"])
            ranked = running_sums(ranked, ["component"], "_blk", ["_ord"], {"_rank": F.lit(1)})
            late = checkpoint(ranked.where(F.col("_rank") > FOLD).select(*columns))
            heads = placed.join(late.select("request_id"), "request_id", "left_anti")
        parted = heads.repartition("component").sortWithinPartitions("component", "_ord")
        kind = und.schema["request_id"].dataType.simpleString()
        decided = parted.select("request_id", "component", "email", "phone").mapInPandas(
            _decide_one_by_one, f"request_id {kind}, accepted boolean"
        )
        if not many:
            done.append(decided)
            break
        decided = checkpoint(decided)
        won, und = heads.join(decided.where("accepted"), "request_id", "left_semi"), late
        for key, out in (("email", "_we"), ("phone", "_wp")):
            und = _marked(und, key, _given(won, key, F.lit(True), out))
        und = checkpoint(und.withColumn("_lost", F.col("_we").isNotNull() | F.col("_wp").isNotNull()).select(*columns, "_lost"))
        done += [decided, und.where("_lost").select("request_id", F.lit(False).alias("accepted"))]
        und = und.where("not _lost").select(*columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def apply_new_hosts(hosts: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Add hosts; email and phone are both unique (an empty phone is stored as NULL, which never collides).

    A request refused on one key does not take its other key, so the two keys
    interact and no single grouped pass decides them. One pass decides what is
    first on both its keys and what collides with that (also a key shared by
    very many requests); the rest is decided by components of shared keys
    (``_by_component``).
    """
    r = requests.select(
        "request_id", "request_ts", "name", "email", empty_to_null("phone").alias("phone"), "role",
        empty_to_null("department").alias("department"),
    ).withColumn("_ord", order_key())
    r = _marked(r, "email", _given(hosts, "email", F.lit(True), "_e_taken"))
    r = _marked(r, "phone", _given(hosts, "phone", F.lit(True), "_p_taken"))
    taken = F.col("_e_taken").isNotNull() | F.col("_p_taken").isNotNull()
    r = checkpoint(r.withColumn("_acc", F.when(taken, F.lit(False))).drop("_e_taken", "_p_taken"))
    easy = _easy_round(r.where("_acc is null").drop("_acc"))
    left = easy.where("_acc is null").drop("_acc")
    state = r.where("_acc is not null").unionByName(easy.where("_acc is not null"))
    if left.limit(1).count() > 0:
        columns = ["request_id", "_ord", "email", "phone"]
        state = state.unionByName(left.join(_by_component(left.select(*columns)), "request_id").withColumnRenamed("accepted", "_acc"))
    reason = F.when(F.col("_acc"), F.lit(None).cast("string")).otherwise(F.lit("DUPLICATE_EMAIL_OR_PHONE"))
    decisions = decide(state, reason, "request_id", "name", "email", "phone", "role", "department")
    delta = decisions.where("accepted").select("request_id", "name", "email", "phone", "role", "department")
    return {
        "decisions": decisions.select("request_id", "email", "phone", "accepted", "reason"),
        "hosts_delta": delta,
    }
